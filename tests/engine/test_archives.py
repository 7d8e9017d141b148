"""Tar archives: index, ranges, damaged ends, parts, sizes over 2 GB, writing."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from plotloom.sources import archives


def add(tar, name, body):
    info = tarfile.TarInfo(name)
    info.size = len(body)
    tar.addfile(info, io.BytesIO(body))


def test_shards_in_ranges(spark, tmp_path):
    """Samples over many small ranges, of which none holds more than a few members; long names, folders, repeats, links and damaged ends."""
    want = {}
    for k in range(3):
        with tarfile.open(tmp_path / f"{k}.tar", "w", format=(tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT)[k]) as tar:
            for i in range(60):
                stem = f"s{i:03d}" + ("x" * 150 if k < 2 and i % 7 == 0 else "")
                add(tar, f"deep/{stem}.json", b'{"n": -1}') if i % 5 == 0 else None
                add(tar, f"deep/{stem}.json", json.dumps({"n": i, "caption": "é" * i}).encode() if i % 11 else b"{bad")
                add(tar, f"deep/{stem}.jpg", b"\x00" * (i * 97)) if i % 3 else None
                if i % 3 and i % 11:
                    want[f"{k}.tar", stem] = i
            link = tarfile.TarInfo("deep/link.json")
            link.type, link.linkname = tarfile.SYMTYPE, "s001.json"
            tar.addfile(link)
    whole = (tmp_path / "2.tar").read_bytes()
    with tarfile.open(tmp_path / "2.tar") as tar:
        cut = next(m for m in tar if m.name == "deep/s040.json")
    (tmp_path / "2.tar").write_bytes(whole[: cut.offset_data + 4])  # in the middle of a member
    (tmp_path / "3.tar").write_bytes(b"no archive")
    (tmp_path / "4.tar").write_bytes(b"")
    want = {k: v for k, v in want.items() if k[0] != "2.tar" or k[1][:4] < "s040"}
    for size in (2_000, 1 << 26):
        rows = archives.shards(spark, str(tmp_path), "n:int,caption:string", range_bytes=size)
        assert {(r.shard, r["sample"]): r.n for r in rows.collect()} == want and all(r.caption == "é" * r.n for r in rows.collect())
    index = archives.tar_index(spark, str(tmp_path / "0.tar"))
    read = archives.members(index, 5_000)
    tasks = {r.t: r.n for r in read.groupBy(F.spark_partition_id().alias("t")).agg(F.sum("size").alias("n")).collect()}
    assert len(tasks) > 10 and max(tasks.values()) < 60_000  # many tasks an archive
    with tarfile.open(tmp_path / "0.tar") as tar:
        assert {(r.place, r.member, bytes(r.content)) for r in read.collect()} == {(i, m.name, tar.extractfile(m).read()) for i, m in enumerate(m for m in tar if m.isreg())}


def test_archive_of_three_gigabytes(spark, tmp_path):
    """A sparse file stands for a member of three gigabytes; what follows it is read by its offset."""
    path = tmp_path / "big.tar"
    with tarfile.open(path, "w") as tar:
        add(tar, "a.json", b'{"n": 1}')
        add(tar, "a.jpg", b"x")
    end = tarfile.open(path).getmembers()[-1]
    with open(path, "r+b") as f:
        f.truncate(end.offset_data + 512)
        f.seek(end.offset_data + 512)
        huge = tarfile.TarInfo("huge.jpg")
        huge.size = 3 << 30
        f.write(huge.tobuf())
        f.seek(3 << 30, 1)
        for name, body in (("huge.json", b'{"n": 2}'), ("b.jpg", b""), ("b.json", b'{"n": 3}')):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            f.write(info.tobuf() + body.ljust(-(-len(body) // 512) * 512, b"\0"))
        f.write(b"\0" * 1024)
    assert path.stat().st_size > 3 << 30
    assert {r["sample"]: r.n for r in archives.shards(spark, str(tmp_path), "n:int").collect()} == {"a": 1, "huge": 2, "b": 3}


def test_parts_and_extract(spark, tmp_path):
    with tarfile.open(tmp_path / "w.tar", "w") as tar:
        for i in range(30):
            add(tar, f"friends/season_{i % 3}/{i}.mp4", bytes([i]) * (i * 131))
            add(tar, f"other/{i}.mp4", b"no")
        add(tar, "x/FRIENDS/y.mp4", b"yes")
    whole = (tmp_path / "w.tar").read_bytes()
    parts = []
    for k, at in enumerate(range(0, len(whole), 7001)):
        parts.append(str(tmp_path / f"w.a{k:02d}"))
        (tmp_path / f"w.a{k:02d}").write_bytes(whole[at : at + 7001])
    found = archives.archive_members(spark, parts)
    assert {(r.member, r.season, r.bytes) for r in found.collect()} == {(f"friends/season_{i % 3}/{i}.mp4", f"season_{i % 3}", i * 131) for i in range(30)} | {("x/FRIENDS/y.mp4", None, 3)}
    for _ in range(2):  # a second time replaces
        assert archives.extract(found, str(tmp_path / "out"), 10_000).agg(F.sum("bytes")).first()[0] == sum(i * 131 for i in range(30)) + 3
    assert all((tmp_path / f"out/friends/season_{i % 3}/{i}.mp4").read_bytes() == bytes([i]) * (i * 131) for i in range(30))
    assert sum(1 for p in (tmp_path / "out").rglob("*") if p.is_file()) == 31
    with pytest.raises(Exception, match="missing|w.zz"):
        archives.archive_members(spark, [*parts, str(tmp_path / "w.zz")]).collect()
    with pytest.raises(Exception, match="leads out"):
        archives.extract(found.withColumn("member", F.lit("../x")), str(tmp_path / "out")).collect()


def test_written_shards(spark, tmp_path):
    rows = spark.range(95).selectExpr("concat('k', id) AS sample", "explode(map('json', concat('{\"n\": ', id, '}'), 'jpg', repeat('x', int(id)))) AS (ending, content)").coalesce(2)
    made = archives.write_shards(rows, str(tmp_path / "s"), 20).collect()
    assert sum(r.members for r in made) == 190 and len(made) >= 5 and sorted(r.shard for r in made) == sorted(p.name for p in (tmp_path / "s").iterdir())
    assert {(r["sample"], r.n) for r in archives.shards(spark, str(tmp_path / "s"), "n:int").collect()} == {(f"k{i}", i) for i in range(95)}
