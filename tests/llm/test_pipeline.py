"""The pipeline as a whole: the brute forces of its stages, one after another, against what each stage and the run give."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plotloom.llm import mixing
from tests.llm.test_rows import WORD, targets_of
from tests.llm.test_sets import odd_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lettered(rows):
    return [r for r in rows if any(map(str.isalpha, r["text"] or ""))]


def one_of_each_group(rows):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for r in rows:
        w = WORD.findall(r["text"].translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    groups = defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        groups[g].append(r)
    return [min(g, key=lambda r: (r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest())) for g in groups.values()]


def without_passages(rows, width=50):
    first = {}
    for r in rows:
        b = r["text"].encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        b = r["text"].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < r["doc_id"]:
                gone[p : p + width] = True
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if gone.any() else r["text"]
        if not gone.any() or WORD.search(text):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def mixed(rows, share=1.5, weights=(3, 1, 2), cap=2, block=64, shard_slots=4096, seed=7):
    names = sorted({r["source"] for r in rows})
    spans = [[m.span() for m in WORD.finditer(r["text"])] for r in rows]
    size = {n: sum(len(s) for r, s in zip(rows, spans, strict=True) if r["source"] == n) for n in names}
    target = targets_of([size[n] for n in names], [weights[i % 3] for i in range(len(names))], share * sum(size.values()), cap)
    words = [max(1, min(block, size[n] // 256)) for n in names]
    blocks = [-(-size[n] // w) for n, w in zip(names, words, strict=True)]
    expected = [t * b / size[n] if size[n] else 0.0 for n, t, b in zip(names, target, blocks, strict=True)]
    most = [min(cap * b, math.ceil(x - 1e-6) + 1) for b, x in zip(blocks, expected, strict=True)]
    total = int(sum(expected) + 1e-6)
    open_ = {k: min(shard_slots, total - k * shard_slots) for k in range(-(-total // shard_slots))}
    taken, shares, turn = [0] * len(names), expected, 0
    while open_:
        back, new, src = Counter(), [0] * len(names), [i for i, x in enumerate(shares) if x > 0]
        q = np.array([shares[i] for i in src])
        for k in sorted(open_):
            for i, n in zip(src, np.random.default_rng([seed, turn, k, 0]).multinomial(open_[k], q / q.sum()).tolist(), strict=True):
                kept = max(0, min(n, most[i] - taken[i] - new[i]))
                new[i], back[k] = new[i] + kept, back[k] + n - kept
        taken = [a + b for a, b in zip(taken, new, strict=True)]
        open_, shares, turn = {k: n for k, n in back.items() if n}, [float(m - t) for m, t in zip(most, taken, strict=True)], turn + 1
    out = []
    for i, n in enumerate(names):
        uses = Counter(int(mixing.permute(np.array([k % blocks[i]]), blocks[i], seed * 1_000_003 + i * 101 + k // blocks[i])[0]) for k in range(taken[i]))
        own = [(r, s) for r, s in zip(rows, spans, strict=True) if r["source"] == n]
        at = 0
        for r, s in sorted(own, key=lambda x: (hashlib.md5(f"{x[0]['doc_id']}|{len(x[1])}".encode()).hexdigest()[:2], x[0]["doc_id"], len(x[1]))):
            often = [uses[(at + k) // words[i]] for k in range(len(s))]
            at += len(s)
            if not s:
                out.append(r)
            for t in range(max(often, default=0)):
                begin = None
                for k in range(len(s) + 1):
                    inside = k < len(s) and often[k] > t
                    if inside and begin is None:
                        begin = k
                    if not inside and begin is not None:
                        whole = begin == 0 and k == len(s)
                        text = r["text"] if whole else r["text"][s[begin][0] : s[k - 1][1]]
                        out.append(r | {"text": text, "n_chars": len(text)})
                        begin = None
    return out


def plain(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_stages_and_run(spark):
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["lang"] and r["source"] for r in rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (lettered, one_of_each_group, without_passages, mixed), strict=False):
        rows = brute(rows)
        got = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert plain(r.asDict() for r in got) == plain(rows), name
        docs = spark.createDataFrame(got, docs.schema).repartition(2)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for r in rows:
        own = [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        ids[r["doc_id"], len(own)].append(own)
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    length, wanted = Counter(), Counter({k: k[1] * len(v) for k, v in ids.items()})
    by_sequence = defaultdict(list)
    for p in pieces:
        length[p.doc_id, p.doc_tokens] += p.length
        crc = {zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in ids[p.doc_id, p.doc_tokens]}
        assert p.ids_crc32 in crc
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert length == wanted
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    sizes = [sum(n for _, n in own) for own in by_sequence.values()]
    assert sum(2048 - n for n in sizes if n & (n - 1)) <= 2048 * 16  # a window that isn't full for each input partition


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and long texts, copies and clashing names, written and read between the stages as run() does."""
    docs = odd_rows(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.where(F.col("text").isNull()).count() == 0  # language ID rejects them
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and pieces
