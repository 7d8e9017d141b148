"""Lists and objects read by byte ranges against a parse from the front."""

import json
import random

import numpy as np
import pytest

from plotloom.sources import json_ranges, scans


def odd_value(rng, depth=0):
    texts = ["", "a", 'q"uote', "back\\slash\\", '\\"', "[{,}]", "é漢😀", "\\\\\\", "\n\t", "]", "{", '\\\\"']
    kind = rng.randint(0, 6 if depth < 4 else 3)
    if kind < 2:
        return "".join(rng.choice(texts) for _ in range(rng.randint(0, 5)))
    if kind == 2:
        return rng.choice([1, -2.5, True, None, 10**20])
    if kind == 3:
        return rng.choice(texts) * rng.randint(0, 30)
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(texts) + str(i): odd_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def test_marks_in_any_cut():
    """However a text is cut into blocks, its marks and depths are those of the whole."""
    rng = random.Random(1)
    for _ in range(60):
        text = json.dumps([odd_value(rng) for _ in range(6)], ensure_ascii=rng.random() < 0.5)
        data = np.frombuffer(text.encode(), np.uint8)
        whole = json_ranges.marks(data, False, 0, False)
        assert whole.level == 0 and not whole.inside
        inside, level, odd, got, start = False, 0, False, [], 0
        while start < len(data):
            n = rng.randint(1, 9)
            m = json_ranges.marks(data[start : start + n], inside, level, odd)
            got += [(start + a, w, d) for a, w, d in zip(m.at.tolist(), m.what.tolist(), m.depth.tolist(), strict=True)]
            inside, level, odd, start = m.inside, m.level, m.odd, start + n
        assert got == list(zip(whole.at.tolist(), whole.what.tolist(), whole.depth.tolist(), strict=True))


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_elements(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(json_ranges, "_BLOCK", 50)
    rng = random.Random(size)
    lists = {f"{k}.json": [odd_value(rng) for _ in range(rng.choice([0, 1, 40]))] for k in range(4)}
    for k, (name, value) in enumerate(lists.items()):
        (tmp_path / "l").mkdir(exist_ok=True)
        (tmp_path / "l" / name).write_text(json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=k % 2 == 0))
    got = {}
    for r in json_ranges.elements(spark, str(tmp_path / "l"), range_bytes=size if size > 7 else 97).collect():
        got.setdefault(r.path.rpartition("/")[2], {})[r.number] = json.loads(r.body)
    assert {n: [v[i] for i in range(len(v))] for n, v in got.items()} == {n: v for n, v in lists.items() if v}
    envelope = {"info": {"annotations": [1]}, "x]": '"annotations": [', "annotations": lists["0.json"] + [{"annotations": [2]}], "z": [5, [6]], "": {}}
    (tmp_path / "e.json").write_text(json.dumps(envelope, indent=1))
    rows = sorted((r.number, r.body) for r in json_ranges.elements(spark, str(tmp_path / "e.json"), "annotations", max(size, 31)).collect())
    assert [json.loads(b) for _, b in rows] == envelope["annotations"] and [n for n, _ in rows] == list(range(len(rows)))
    keyed = {f"k{i}\"é": {"n": i, "t": rng.choice(["a", "}", ',"']) * i} for i in range(30)}
    (tmp_path / "k.json").write_text(json.dumps(keyed))
    rows = json_ranges.elements(spark, str(tmp_path / "k.json"), range_bytes=max(size, 31))
    key, value = json_ranges.keyed_body(rows.body, "n:int,t:string")
    assert {r.number: (r.key, r.value.n, r.value.t) for r in rows.select("number", key.alias("key"), value.alias("value")).collect()} == {i: (k, v["n"], v["t"]) for i, (k, v) in enumerate(keyed.items())}


def test_scans_of_large_files(spark, tmp_path, monkeypatch):
    """The scans give the same rows whether a file is taken whole or in ranges."""
    rows = [{"image_id": str(i), "caption": f'c "{i}" [' * 3} for i in range(400)]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "e.json").write_text(json.dumps({"info": {}, "annotations": rows}))
    (tmp_path / "k.json").write_text(json.dumps({"a": {str(r["image_id"]): r for r in rows}, "b": 1}))
    (tmp_path / "m.json").write_text(json.dumps({str(r["image_id"]): r for r in rows}))

    def found():
        schema = "image_id:string,caption:string"
        reads = [
            scans.annotations(spark, str(tmp_path / "l.json"), schema), scans.annotations(spark, str(tmp_path / "e.json"), schema), scans.annotations(spark, [str(tmp_path / "l.json"), str(tmp_path / "e.json")], schema),
            scans.enveloped(spark, str(tmp_path / "e.json"), "annotations", schema), scans.keyed(spark, str(tmp_path / "k.json"), schema, "a"), scans.keyed(spark, str(tmp_path / "m.json"), schema),
        ]
        return [(df.columns, df.dtypes, sorted(map(str, df.collect()))) for df in reads]

    whole = found()
    monkeypatch.setattr(scans, "WHOLE", 1000)
    monkeypatch.setattr(scans, "RANGE", 2000)
    assert found() == whole


def test_small_ranges_share_tasks(spark, tmp_path):
    """Very many small ranges are not as many tasks, and elements longer than many ranges are read to their end."""
    rows = [{"k": i, "t": "x]" * (i % 7) * (4000 if i % 50 == 0 else 1)} for i in range(600)]
    (tmp_path / "e.json").write_text(json.dumps({"info": [1], "a": rows, "end": "]"}))
    dealt, tasks = json_ranges._ranges(spark, [str(tmp_path / "e.json")], 64)
    assert dealt.count() > 1000 and dealt.rdd.getNumPartitions() == tasks <= 4 * spark.sparkContext.defaultParallelism
    found = json_ranges.elements(spark, str(tmp_path / "e.json"), "a", 64).orderBy("number").collect()
    assert [json.loads(r.body) for r in found] == rows
