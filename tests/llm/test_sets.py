"""Substring dedup, near duplicates, neighbours, packing, languages and the pipeline against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from plotloom.llm import components, forest, language_crf, packing, simhash, suffix_dedup
from plotloom.llm.lyndon import suffix_arrays
from plotloom.llm.word_bpe import WordBpe
from tests.llm.test_rows import LONG, ODD, SCHEMA, WORD

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def odd_rows(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS size", "2 AS gid", "3 AS sha", "4 AS print", "5 AS key", "6 AS _sha", "7 AS held_out")


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(200):
        strings = [[*rng.integers(1, 1 + rng.integers(1, 5), rng.integers(0, 40)), 0] for _ in range(rng.integers(1, 6))]
        begin = np.cumsum([0, *map(len, strings)])
        got = suffix_arrays(np.concatenate(strings), begin)
        for k, s in enumerate(strings):
            assert list(got[begin[k] : begin[k + 1]] - begin[k]) == sorted(range(len(s)), key=lambda j: s[j:])


def brute_spans(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if d is not None and (w not in first or d < first[w]):
                first[w] = d
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if d is not None and first[b[p : p + width]] < d:
                gone[p : p + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(40)) for _ in range(4)] + ["ab" * 200, "é" * 90]
    rows = [(i // 2 * 3 if i % 7 else None, "".join(rng.choice([word() * 3, rng.choice(passages), rng.choice(passages)[5:70]]) for _ in range(rng.randint(0, 9)))) for i in range(160)]
    rows += [(1000 + i, "a line that very many hold, with more than fifty bytes in it. " + "".join(word() for _ in range(20))) for i in range(60)]
    rows += rows[:10] + [(7, rows[0][1]), (2, rows[3][1])] + [(d, t) for d, t, *_ in ODD]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, sha int, gid int")
    for many, hot, group in ((3, 1, 4000), (192, 256, 2 << 20)):  # the first cuts every class again, before and after it travels
        monkeypatch.setattr(suffix_dedup, "_MANY", many)
        monkeypatch.setattr(suffix_dedup, "_GROUP_BYTES", group)
        monkeypatch.setattr(suffix_dedup, "_BUCKET_BYTES", 4 * group)
        got = Counter(tuple(r) for r in suffix_dedup.dedup_substrings(df, hot).collect())
        assert got == brute_spans(rows)
    assert suffix_dedup.dedup_substrings(df.limit(0)).count() == 0
    assert suffix_dedup.drop_repeated_substrings(odd_rows(spark)).columns == odd_rows(spark).columns


def test_earliest_strings(monkeypatch):
    """The same answer however classes are parted and batched, and that of a plain dictionary."""
    rng = random.Random(12)
    parts = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(12)]
    texts = [("".join(rng.choice(parts)[: rng.randint(20, 60)] for _ in range(30))).encode() for _ in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, starts, ends, classes = suffix_dedup.fragments(data, offsets)
    docs = np.array([rng.randint(0, 40) for _ in texts])[row]
    first = {}
    for s, e, d in zip(starts, ends, docs, strict=True):
        for p in range(s, e - 49):
            w = data[p : p + 50].tobytes()
            first[w] = min(int(d), first.get(w, 99))
    want = [first[data[p : p + 50].tobytes()] for s, e in zip(starts, ends, strict=True) for p in range(s, e - 49)]
    for many, size in ((10**9, 1 << 30), (3, 1 << 30), (16, 5000)):
        monkeypatch.setattr(suffix_dedup, "_MANY", many)
        monkeypatch.setattr(suffix_dedup, "_SORTED", size)
        begin, found = suffix_dedup.earliest(data, starts, ends, classes, docs)
        assert found.tolist() == want and begin[-1] == len(want)


def test_passages_cut(spark):
    """The texts that the pipeline's stage leaves, against the brute force."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh éü") for _ in range(120))
    rows = [(i, rng.choice(["", passage[:70], passage, "pre " + passage[20:] + " post", "own words " + "".join(rng.choice("xyz ") for _ in range(60))]), "en", rng.choice(["a", None]), 5) for i in range(40)]
    rows += [(None, passage, None, None, None), (7, rows[7][1], "en", "a", 5), (99, None, "en", "a", 0)]
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if d is not None:
                first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    want = Counter()
    for d, t, lang, source, n in rows:
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for p in range(len(b) - 49):
            if d is not None and first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if gone.any() and not WORD.search(left):
            continue
        want[d, left if gone.any() else t, lang, source, None if t is None else len(left if gone.any() else t)] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, suffix_dedup.drop_repeated_substrings(df).collect())) == want


def test_long_runs(spark):
    n = 1 << 20
    rng = random.Random(8)
    odd = "".join(rng.choice(["xyzzy plugh frotz gnusto q", "xyzzy plugh frotz gnusto r", "xyzzy plugh frotz gnusto"]) for _ in range(20_000))
    rows = [(1, " " * n + "first"), (2, " " * n + "second"), (3, "tail" + " " * (n + 7)), (4, "abc" * (n // 3)), (5, "x" + "abc" * (n // 3)), (6, odd), (7, odd[5:] + "!")]
    began = time.time()
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert [got[k].n_removed for k in range(1, 8)] == [0, n, n + 7, 0, n // 3 * 3, 0, len(odd) - 5]
    assert [got[k].n_spans for k in range(1, 8)] == [0, 1, 1, 0, 1, 0, 1]
    assert got[3].kept_sha256 == hashlib.sha256(b"tail").hexdigest()
    texts = [np.concatenate([np.ones(n, np.int64), [0]]), np.array([*([1, 2] * 500), 0])]
    began = time.time()
    for t in texts:
        suffix_arrays(t[-50_000:], np.array([0, min(len(t), 50_000)]))
    assert time.time() - began < 10


def brute_print(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = list(parent)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in every}


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(d, t) for d, t, *_ in ODD]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, print int, root int")
    prints = {t: brute_print(t) for _, t in rows}
    root = brute_groups(set(prints.values()))
    least = defaultdict(list)
    for d, t in rows:
        if d is not None:
            least[root[prints[t]]].append(d)
    want = Counter((d, f"{prints[t]:016x}", min(least[root[prints[t]]], default=None)) for d, t in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_survivors(rows):
    """(doc_id, text) of the rows that stay: one of each component of texts with a 5-word Jaccard similarity of 0.8 or more."""
    sets, holders = {}, defaultdict(list)
    for t in sorted({t or "" for _, t in rows}):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t)]
        sets[t] = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
        for s in sets[t]:
            holders[s].append(t)
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    empty = [t for t in sets if not sets[t]]
    pairs = {(empty[0], t) for t in empty}
    for t, own in sets.items():
        common = Counter(u for s in own for u in holders[s])
        pairs |= {(t, u) for u, n in common.items() if n >= 0.8 * (len(own) + len(sets[u]) - n) - 1e-9}
    for t, u in pairs:
        a, b = find(t), find(u)
        root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for d, t in rows:
        groups[find(t or "")].append((d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), t))
    return Counter((None if last else d, t or "") for last, d, _, t in (min(g, key=lambda r: r[:3]) for g in groups.values()))


def test_near_copies_dropped(spark):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(d, t) for d, t, *_ in ODD]
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(400)]
    for i in range(60):  # a chain of edits, so that a group reaches past its least set
        base[rng.randint(0, 399)] = f"x{i}"
        rows.append((50_000 + rng.randint(0, 40), " ".join(base)))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, set int, root int")
    straddling = [f"u{rng.randint(0, 10**6)}" for _ in range(120)]
    for i in range(150):  # copies of one text with few to many edits, so that some have no link, or only links to some
        own = list(straddling)
        for k in rng.sample(range(120), rng.randint(0, 8)):
            own[k] = f"y{i}x{k}"
        rows.append((60_000 + i, " ".join(own)))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, set int, root int")
    want = brute_survivors(rows)
    for most in (4096, 9):  # the second deals large buckets to blocks
        out = simhash.drop_near_duplicates(df, most=most)
        assert out.columns == df.columns
        assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


def test_bands_of_loose_sets(spark, monkeypatch):
    """Texts with much in common that are no near copies: their bands are parted again instead of meeting block by block, and planted near copies are found."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(common + [f"u{k}x{i}" for i in range(32)]) for k in range(500)]
    for k in range(0, 60, 2):
        words = texts[k].split(" ")
        texts[k + 1] = " ".join(words[:-3] + [f"n{k}", *words[-2:]])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(simhash, "DEEP", (40, 6))
    for levels in (3, 0):
        monkeypatch.setattr(simhash, "LEVELS", levels)
        kept = {r.doc_id for r in simhash.drop_near_duplicates(df, most=20).collect()}
        assert kept == set(root), (levels, len(kept), len(set(root)))
    assert len(set(root)) == 470


def test_near_copies_link_by_simhash(spark):
    """Near copies whose fingerprints are close are found without a common band, and close fingerprints alone link nothing."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    few = [f"z{i}" for i in range(30)]
    rows += [(100, " ".join(few * 40)), (101, " ".join(few * 40 + [f"y{i}" for i in range(20)]))]  # the repeats fix the bits, not the set
    prints = dict(simhash.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect())
    close = [d for d in prints if d % 2 == 0 and (prints[d] ^ prints[d + 1]).bit_count() <= 3 and (prints[d] ^ prints[d + 1]) >= 0]
    assert 100 in close and len(close) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df, bands=1, rows=4000).collect()}  # a band that only equal sets share
    assert all(d in kept and (d + 1 in kept) == (d == 100) for d in close)


def test_survivors_are_rows(spark):
    words = lambda k: [f"{k}w{i}" for i in range(100)]
    a, b, c = (" ".join(words(k)) for k in "abc")
    near = " ".join([*words("c")[:-1], "other"])
    rows = [(1, a), (1, b), (2, a), (3, c), (3, near), (None, near + " x"), (None, "d " + a), (None, "alone without a number"), (None, "alone without a number")]
    got = Counter(tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    third = min((c, near), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == Counter([(1, a), (1, b), (3, third), (None, "alone without a number")])


def test_pigeonholes_find_all(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40)
    some = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            some.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in some]
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    root = brute_groups(some)
    want = defaultdict(set)
    for p, r in root.items():
        want[r].add(p)
    for most in (16384, 30):  # the second cuts large buckets again
        got = defaultdict(set)
        for r in simhash.similar_groups(df, most_bucket=most).collect():
            got[r.root].add(r.print % 2**64)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: r for n, r in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def brute_near(rows, every=100, k=10):
    out = {}
    valid = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, v in valid:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((np.array(w, np.float64) - np.array(v, np.float64)) ** 2).sum())), i) for i, w in valid if i != q)[:k]
    return out


def test_forest(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = defaultdict(list)
    for r in forest.nearest_neighbours(table).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    want = brute_near(rows)
    assert set(found) == set(want)
    distance = {q: dict((i, s) for s, i in brute_near([r for r in rows], every=100, k=len(rows))[q]) for q in list(want)[:3]}
    for q, d in distance.items():
        assert all(abs(s - d[i]) < 1e-12 for s, i in found[q]) and found[q] == sorted(found[q])
    recall = np.mean([len({i for _, i in found[q]} & {i for _, i in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.9
    vectors = np.array([v for _, v in rows[:3000]], np.float64)
    trees = forest.Forest.fit(vectors, 5, 20, 3)
    keys = trees.keys(vectors[:20])
    for share in (0.01, 0.2, 1.0):
        for own, bound, query in zip(keys, trees.bounds(keys, share), vectors, strict=False):
            taken, (sure, most) = set(trees.search(query, share)), (set(map(tuple, np.argwhere(own < bound * (1 + e)).tolist())) for e in (-1e-9, 1e-9))
            assert sure <= taken <= most | set(map(tuple, np.argwhere(own == bound).tolist()))
    copies = [(i, [1.0, 0.0]) for i in range(300)] + [(7, [0.0, 3.0]), (7, [0.0, 2.0])] + [(5, [1.0, 0.0])] * 500
    table = spark.createDataFrame(copies, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in forest.nearest_neighbours(table, every=150, k=3, block_bytes=1000, most_queries=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (150, 1, 0, 0.0), (150, 2, 1, 0.0), (150, 3, 2, 0.0)]
    tiny = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (200, [float("nan"), 1.0]), (9, [0.0, 2.0]), (None, [1.0, 1.0]), (11, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in tiny], "vec_id long, embedding array<float>, key int, ids int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in forest.nearest_neighbours(df).orderBy("query_id", "rank").collect()]
    far = 5**0.5
    assert got == [(0, 1, 7, 0.0), (0, 2, 100, 0.0), (0, 3, 9, far), (100, 1, 0, 0.0), (100, 2, 7, 0.0), (100, 3, 9, far)]
    assert forest.nearest_neighbours(df.limit(0)).count() == 0


def test_packing(spark):
    library = WordBpe(TOKENIZER).library
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(10_000 + i, t) for i, (_, t, *_) in enumerate(ODD)]
    docs += [(20_000, "don't <|endoftext|>x <|ENDOFTEXT|> İ ß ẞ É×÷ Á µ a'sb !'s \x00\x1c Ǆ é " + LONG[:3000])]
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    rows = packing.pack_documents(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, offset int"), TOKENIZER).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in ids:
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == len(ids[d])
    padded = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    total = sum(map(len, ids.values()))
    assert padded <= total + 2048 * 8  # a window for each of the eight input partitions
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_crf.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.98
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, language_crf.identify(other).collect())) == sorted(map(tuple, rows))  # held-out labels and sources play no part
    odd = {r.doc_id: r for r in language_crf.identify(odd_rows(spark)).collect()}
    assert odd[1].lang_pred == "und" and odd[5].lang_pred == "und" and odd[5].score == 0 and not odd[None].held_out
    assert language_crf.identify(docs.limit(0)).count() == 0


def test_language_of_many_copies(spark):
    """A language is learned from its distinct texts, however often they repeat."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    few = docs.where("lang = 'fr' AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").orderBy("doc_id").limit(5)
    copies = few.crossJoin(spark.range(20_000)).select("text", "lang", F.expr("1000000 + id * 10 + doc_id % 10 AS doc_id"))
    rows = docs.where("lang <> 'fr'").select("text", "lang", "doc_id")
    assert language_crf.learn(rows.unionByName(copies)).labels == language_crf.learn(rows.unionByName(few.select("text", "lang", "doc_id"))).labels == ["de", "en", "es", "fr"]


def test_languages_have_a_bound(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id % 1500, ' other thing') AS text", "concat('l', id % 600) AS lang")
    crf = language_crf.learn(rows, total=400, weights_mb=1)
    assert len(crf.labels) == 400 and crf.weights.nbytes <= 1 << 20


def test_labels_and_scores_word_by_word(spark):
    """lang_pred and score of whole texts against sums over all paths of a plain forward-backward in logarithms."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(odd_rows(spark).where("length(coalesce(text, '')) < 1000").select("doc_id", "text", "lang"))
    crf = language_crf.learn(docs, documents=20, words=30)

    def brute(text):
        words = [language_crf.plain(w) for w in WORD.findall(text or "") if any(map(str.isalpha, w))]
        if not words:
            return "und", 0.0
        first, used = language_crf.word_features(words, crf.bits)
        emit = np.array([crf.weights[used[a:b]].astype(float).sum(0) for a, b in zip(first[:-1], first[1:], strict=True)])
        ahead, back = [emit[0]], [np.zeros(len(crf.labels))]
        for e in emit[1:]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + crf.moves, 0) + e)
        for e in emit[:0:-1]:
            back.append(np.logaddexp.reduce(crf.moves + (e + back[-1])[None, :], 1))
        joint = np.array(ahead) + np.array(back[::-1])
        mean = np.exp(joint - np.logaddexp.reduce(joint, 1)[:, None]).mean(0)
        return crf.labels[int(mean.argmax())], float(mean.max())

    texts = Counter((r.doc_id, *brute(r.text)[:1], round(brute(r.text)[1], 6)) for r in docs.collect())
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_crf.identify(docs, crf).collect()) == texts


def test_missing_languages_are_named(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    named = {r.doc_id: r.lang_pred for r in language_crf.identify(docs).collect()}
    given = {r.doc_id: r.lang for r in docs.collect()}
    out = language_crf.drop_unidentified(docs).collect()
    assert out and all(r.lang == (given[r.doc_id] or named[r.doc_id]) for r in out)
    assert {r.doc_id for r in out} == {d for d, p in named.items() if p != "und"}


def test_forward_backward():
    rng = np.random.default_rng(0)
    crf = language_crf.Crf(["a", "b", "c"], np.zeros((2, 3)), rng.normal(size=(3, 3)), 1)
    lengths = np.array([1, 150, 64, 3])
    score = rng.normal(size=(lengths.sum(), 3))
    got, pairs = crf.forward_backward(score, lengths, pairs=True)
    at, total = 0, np.zeros((3, 3))
    for n in lengths:
        e, m = np.exp(score[at : at + n]), np.exp(crf.moves)
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        now = np.ones(3)
        for t in range(n):
            now = (now @ m if t else now) * e[t]
            f[t] = now = now / now.sum()
        for t in range(n - 2, -1, -1):
            b[t] = m @ (b[t + 1] * e[t + 1])
            b[t] /= b[t].sum()
        want = f * b / (f * b).sum(1, keepdims=True)
        assert np.allclose(got[at : at + n], want)
        for t in range(1, n):
            j = f[t - 1][:, None] * m * (e[t] * b[t])[None]
            total += j / j.sum()
        at += n
    assert np.allclose(pairs, total)


def test_transition_gradient():
    rng = np.random.default_rng(1)
    crf = language_crf.Crf(["a", "b", "c"], np.zeros((2, 3)), rng.normal(size=(3, 3)), 1)
    lengths, y = np.array([3, 1, 4]), rng.integers(0, 3, 8)
    score = rng.normal(size=(8, 3))
    spans = [(0, 3), (3, 4), (4, 8)]

    def loss():
        out = 0.0
        for a, b in spans:
            weight = lambda p, a=a, b=b: sum(score[a + i, p[i]] for i in range(b - a)) + sum(crf.moves[u, v] for u, v in zip(p, p[1:], strict=False))
            out += np.log(sum(np.exp(weight(p)) for p in product(range(3), repeat=b - a))) - weight(y[a:b].tolist())
        return out

    _, pairs = crf.forward_backward(score, lengths, pairs=True)
    for a, b in spans:
        np.subtract.at(pairs, (y[a : b - 1], y[a + 1 : b]), 1)
    for i, j in product(range(3), repeat=2):
        crf.moves[i, j] += 1e-5
        up = loss()
        crf.moves[i, j] -= 2e-5
        down = loss()
        crf.moves[i, j] += 1e-5
        assert abs((up - down) / 2e-5 - pairs[i, j]) < 1e-6


def test_plain_words():
    words = ["", "a", "Abc", "it's", "(x)", "--", "12", "A1b2", "été", "«Où»", "ÄÖ!", "x\u00a0y", "漢字,", "İ", "ß9", "'tis"]
    import pyarrow as pa

    data, sizes, lettered = language_crf.plain_words(pa.array([b"skip", *(w.encode() for w in words)], pa.large_binary()).slice(1))
    ends = np.cumsum(sizes)
    assert [data[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)] == [language_crf.plain(w) for w in words]
    assert lettered.tolist() == [any(map(str.isalpha, w)) for w in words]


def test_unidentified_dropped(spark):
    letters = lambda t: any(map(str.isalpha, t or ""))
    want = Counter((d, t) for d, t, *_ in ODD if letters(t))
    df = odd_rows(spark)
    for rows in (df, df.withColumn("lang", F.lit(None).cast("string"))):  # the second has nothing to learn from
        out = language_crf.drop_unidentified(rows)
        assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert {r.lang_pred for r in language_crf.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    switched = docs.withColumn("text", F.concat(F.lit("le chien mange dans la maison the dog eats in the house der Hund frisst in dem Haus "), F.substring("text", 1, 40)))
    assert language_crf.drop_unidentified(switched).count() == switched.count()
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 90))  # ninety languages: shorter slices, the same rows
    assert Counter(map(tuple, language_crf.drop_unidentified(many).collect())) == Counter(tuple(r) for r in many.collect() if letters(r.text))


def test_code_switching():
    words = {"en": "the quick brown house thing with through".split(), "xx": "zorvak ümlaki qrötz vankiz ötzel kravüm".split()}
    rng = random.Random(1)
    crf = language_crf.Crf.fit([(y, [rng.choice(w).encode() for _ in range(60)]) for y, w in words.items() for _ in range(20)])
    text = " ".join(words["en"] + words["xx"] + words["en"]).encode()
    _, _, _, marginal = crf.label_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    label = [crf.labels[i] for i in marginal.argmax(1)]
    assert label == ["en"] * 7 + ["xx"] * 6 + ["en"] * 7


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and len(rows) > 50
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_rows(spark), "").columns == odd_rows(spark).columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_forest_of_clusters(spark):
    """On clustered vectors a query reranks a small share of the rows; few rows all come back."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(150, 48))[rng.integers(0, 150, 12_000)] + 0.3 * rng.normal(size=(12_000, 48))
    trees = forest.Forest.fit(rows, 12, 48, 11).calibrated(rows, 0.96, 10, 128, 11)
    leaves, keys = trees.leaves(rows), trees.keys(rows[:200])
    opened = [np.any([near[t][leaves[t]] for t in range(12)], 0) for near in keys <= trees.bounds(keys)[:, None, None]]
    assert np.mean(opened) < 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    want = brute_near([(i, tuple(v)) for i, v in enumerate(rows.tolist())])
    found = defaultdict(set)
    for r in forest.nearest_neighbours(df).collect():
        found[r.query_id].add(r.vec_id)
    assert np.mean([len(found[q] & {i for _, i in w}) / len(w) for q, w in want.items()]) >= 0.9
    few = [(0, [5.0, 1.0]), (1, [-5.0, -1.0])] + [(i, [0.01 * i, 0.02]) for i in range(2, 8)]
    got = forest.nearest_neighbours(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(1, 8))


def test_distances_of_extreme_vectors(spark):
    """Components whose squares are no doubles: the order and the scores are those of the true distances."""
    rows = [(0, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [4e200, 1.0]), (3, [1e-200, 1e-200]), (4, [3e-200, 1e-200]), (5, [3.0, 4.0]), (100, [0.0, 1e-200])]
    got = forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert [i for i, _ in by[100]] == [3, 4, 5, 0, 1, 2] and [i for i, _ in by[0]] == [1, 3, 4, 5, 100, 2]  # five of them at 1e200
    want = {3: 1e-200, 4: 3e-200, 5: 5.0, 0: 1e200, 1: 2e200, 2: 4e200}
    assert all(abs(s - want[i]) <= 1e-12 * want[i] for i, s in by[100])
