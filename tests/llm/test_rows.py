"""Sharding, line quality, mixing, token counts and URL filters against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from plotloom.llm import line_quality, mixing, sharding, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = "the quick brown fox jumps " * 4000 + "é" * 3000 + " tail\n" * 10
ODD = [
    (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "one two three one two three\nsame line\n same line\nsame line", "en", "a", 1),
    (3, "one two three one two three\nsame line\n same line\nsame line", "en", "a", 1), (4, LONG, None, "b", 1), (None, "x y z", "fr", None, 5), (5, " \t\n\x0b", "de", "é", 4),
    (6, " a  b\u00a0c#\u2581d<s> ﬁ漢字\n\n\x00", "de", "b", 4), (7, "word " * 60, "en", "c", 3), (-8, " ".join(f"w{i}" for i in range(80)), "en", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS size", "2 AS _bucket", "3 AS host", "4 AS src", "5 AS row", "6 AS shard")


def jump(key: int, n: int) -> int:
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 8), jump(r.doc_id or 0, 9))
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    keys = [*range(-50, 50), 2**63 - 1, -(2**63), 987654321987654321]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.s for r in df.select("k", sharding.jump_shard(df.k, 1000).alias("s")).collect()}
    assert got == {k: jump(k, 1000) for k in keys}
    assert sharding.shard_documents(odd.limit(0)).count() == 0
    copies = spark.range(200_000).selectExpr("CASE WHEN id % 3 > 0 THEN 5 ELSE id END AS doc_id", "CASE WHEN id % 3 > 0 THEN 'the same' ELSE 't' || id % 7 END AS text")
    found = sharding.shard_documents(copies, 100).selectExpr("shard", "slot", "doc_id", "grown_shard").toPandas()
    assert len(found) == 200_000 and (found.doc_id == 5).sum() == 133_333
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert all(r.shard == jump(r.doc_id, 100) and r.grown_shard == jump(r.doc_id, 101) for r in found.drop_duplicates("doc_id").itertuples())


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def brute_quality(rows, share, least, min_left=0.5):
    norm = lambda x: tuple(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(x))
    holds, texts = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in rows:
        texts[s].add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                holds[s, norm(x)].add(t or "")
    bad = {k for k, v in holds.items() if len(v) >= least and len(v) > share * len(texts[k[0]])}
    out = Counter()
    for d, t, _, s, _ in rows:
        b = base(t)
        gone = sum(len(norm(x)) for x in (t or "").split("\n") if (s, norm(x)) in bad)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        left = b[0] - gone
        out[d, *b, failed, not failed and not (gone and (left < min_left * b[0] or left < 50)), left] += 1
    return out


def test_quality(spark, odd):
    rows = [(*r[:1], r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows += [(1000 + i, "Shared  LINE here\n" + body(i if i < 30 else 0) + ("\nshared line here " + "z " * 99 if i == 1 else ""), "en", "hot", 0) for i in range(40)]
    rows += [(2000 + i, "\n".join(["a long line that many hold " * 1 + body(7)] + [f"own {i}"] * (i % 2)), "en", "copies", 0) for i in range(30)]
    morse = ["a"]
    for _ in range(10):
        morse.append(morse[-1] + morse[-1].translate({97: "b", 98: "a"}))  # strings on which polynomial hashes modulo 2**64 are equal
    one, two = morse[-1], morse[-1].translate({97: "b", 98: "a"})
    rows += [(3000, f"{one}\n{two}\n{one}", "en", "t", 0), (3001, f"{one} p q {two} p q " + body(1), "en", "t", 0), (3002, f"{one} {two}\n{two} {one}\n{one}{two}\n", "en", "t", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for share, least in ((0.03, 10), (0.3, 2)):
        got = Counter(tuple(r) for r in line_quality.quality_rules(df, host_share=share, least_documents=least).collect())
        assert got == brute_quality(rows, share, least)
    assert Counter(tuple(r) for r in line_quality.quality_rules(odd).collect()) == brute_quality(ODD, 0.03, 10)
    assert line_quality.quality_rules(odd.limit(0)).count() == 0


def test_mix(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_sources(df).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in df.collect())
    taken, target = Counter(), {}
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = (r.target, r.source_size)
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-3
    names = sorted(target)
    free = {n: target[n][0] / (3, 1, 2)[i % 3] for i, n in enumerate(names) if target[n][0] < 2 * target[n][1]}
    assert max(free.values()) - min(free.values()) < 1e-6 * max(free.values())
    assert all(target[n][0] == 2 * target[n][1] <= (3, 1, 2)[names.index(n) % 3] * max(free.values()) for n in names if n not in free)
    for n in names:
        assert abs(taken[n] - target[n][0]) < 0.02 * target[n][0] + 200
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()))
    small = mixing.mix_sources(odd).collect()
    assert Counter((r.doc_id, r["size"]) for r in small) == Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in ODD)
    assert mixing.mix_sources(odd.limit(0)).count() == 0

    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(words[r.doc_id] == r.taken for r in rows)
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() > 0


def test_mix_of_ties(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{chr(97 + rng.randint(0, 25))}{i}{k}" for k in range(90)) for i in range(120)]
    rows = [(None if i % 2 else 5, t, "en", "abc"[i % 3], i % 4) for i, t in enumerate(texts)] * 2 + [(9, None, "en", "a", 0), (9, "", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = [Counter(map(tuple, mixing.mixed_documents(df.repartition(n)).collect())) for n in (3, 7)]
    assert runs[0] == runs[1]
    whole = Counter(w for _, t, _, _, _ in rows for w in WORD.findall(t or ""))
    used = Counter(w for r, n in runs[0].items() for w in WORD.findall(r[1] or "") for _ in range(n))
    assert used and all(used[w] <= 2 * whole[w] for w in used)


def test_shard_draws(spark, monkeypatch):
    """Each shard's counts spread as a draw of every one of its slots, also where sources are drawn in groups; no shard's depend on another's."""
    shares = [1000.0, 30.0, 0.0, 470.0, 500.0]
    df = spark.createDataFrame(list(enumerate(shares)), "src long, share double")
    open_ = spark.range(300).selectExpr("id AS shard", "4096L AS n")
    p = np.array(shares) / sum(shares)
    for group in (4096, 2):
        monkeypatch.setattr(mixing, "GROUP", group)
        got = mixing.draw_counts(open_, df, 5, 7, 0).toPandas().pivot_table(index="shard", columns="src", values="n", fill_value=0)
        assert (got.sum(1) == 4096).all() and list(got.columns) == [0, 1, 3, 4]
        at = [0, 1, 3, 4]
        assert np.all(np.abs(got.mean() / (4096 * p[at]) - 1) < 0.03) and np.all(np.abs(got.std() / np.sqrt(4096 * p[at] * (1 - p[at])) - 1) < 0.15)
        few = mixing.draw_counts(open_.where("shard BETWEEN 100 AND 110"), df, 5, 7, 0).toPandas().pivot_table(index="shard", columns="src", values="n", fill_value=0)
        assert few.equals(got.loc[100:110])


def targets_of(sizes, weights, wanted, cap):
    """Shares by weight; what a target has over cap * size is shared again among the rest."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], min(float(wanted), float(cap * sum(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


def brute_taken(rows, share=1.5, weights=(3, 1, 2), cap=2, block=64, shard_slots=4096, seed=7, draw_seed=7):
    """Words taken of each row (doc_id, text, source), one after another: sources, targets, order, draws of each shard, permutations."""
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    size = {n: sum(len(WORD.findall(t or "")) for _, t, s in rows if s == n) for n in names}
    target = targets_of([size[n] for n in names], [weights[i % 3] for i in range(len(names))], share * sum(size.values()), cap)
    words = [max(1, min(block, size[n] // 256)) for n in names]
    blocks = [-(-size[n] // w) for n, w in zip(names, words, strict=True)]
    expected = [t * b / size[n] if size[n] else 0.0 for n, t, b in zip(names, target, blocks, strict=True)]
    most = [min(cap * b, math.ceil(x - 1e-6) + 1) for b, x in zip(blocks, expected, strict=True)]
    total = int(sum(expected) + 1e-6)
    open_ = {k: min(shard_slots, total - k * shard_slots) for k in range(-(-total // shard_slots))}
    taken, shares, turn = [0] * len(names), expected, 0
    while open_:
        back, new = Counter(), [0] * len(names)
        src = [i for i, x in enumerate(shares) if x > 0]
        q = np.array([shares[i] for i in src])
        for k in sorted(open_):
            for i, n in zip(src, np.random.default_rng([draw_seed, turn, k, 0]).multinomial(open_[k], q / q.sum()).tolist(), strict=True):
                kept = max(0, min(n, most[i] - taken[i] - new[i]))
                new[i] += kept
                back[k] += n - kept
        taken = [a + b for a, b in zip(taken, new, strict=True)]
        open_, shares, turn = {k: n for k, n in back.items() if n}, [float(m - t) for m, t in zip(most, taken, strict=True)], turn + 1
    out = []
    for i, n in enumerate(names):
        own = [(d, len(WORD.findall(t or ""))) for d, t, s in rows if s == n]
        key = lambda r: (hashlib.md5(f"{'~' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()[:2], r[0] is not None, r[0] or 0, r[1])
        uses = Counter(int(mixing.permute(np.array([k % blocks[i]]), blocks[i], seed * 1_000_003 + i * 101 + k // blocks[i])[0]) for k in range(taken[i]))
        at = 0
        for d, z in sorted(own, key=key):
            out.append((d, z, round(target[i], 6), sum(uses[w // words[i]] for w in range(at, at + z))))
            at += z
    return Counter(out)


def taken_of(rows):
    return Counter((r.doc_id, r["size"], round(r.target, 6), r.taken) for r in rows.collect())


def test_taken_by_brute_force(spark, odd, monkeypatch):
    small = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(7 * (1 + i % 10))), "en", f"s{i % 60:02d}", 1) for i in range(240)], SCHEMA)
    for df in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd, small):
        rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        assert taken_of(mixing.mix_sources(df)) == brute_taken(rows)
    draws = [taken_of(mixing.mix_sources(small, draw_seed=s, shard_slots=64)) for s in (1, 2)]
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()]
    assert draws == [brute_taken(rows, draw_seed=s, shard_slots=64) for s in (1, 2)] and draws[0] != draws[1]  # the draws decide
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert taken_of(mixing.mix_sources(small, draw_seed=1, shard_slots=64)) == draws[0]


@pytest.mark.parametrize("share", [0.4, 1.5, 1.95, 3.0])
def test_small_sources_meet_their_targets(spark, share):
    """Sixty sources of about 70 words, one large one: taken words miss the target by a few words; no document is taken more than twice."""
    rows = [(i, " ".join(["w"] * 70), "en", f"s{i:02d}", 1) for i in range(60)] + [(100 + i, " ".join(["w"] * 997), "en", "t", 1) for i in range(90)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), share=share).collect()
    source, taken, target, size = {r[0]: r[3] for r in rows}, Counter(), {}, {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
    assert all(abs(taken[n] - target[n]) <= 3 + 0.02 * target[n] for n in target), [(n, taken[n], target[n]) for n in target if abs(taken[n] - target[n]) > 3 + 0.02 * target[n]]


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))


def test_tokens(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = token_counts.Resynchroniser(path).model
    rows = token_counts.count_tokens(odd, path, chunk=100, overlap=4).collect()
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t, *_ in ODD)
    assert Counter(tuple(r) for r in rows) == want
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [LONG, "a" * 5000, " " * 5000, "\u2581" * 300 + "x y" * 300, "漢字" * 2000, "ab\n" * 1000, "😀🏳️‍🌈 " * 400, "e\u0301" * 700, "".join(chr(33 + i * 7919 % 5000) for i in range(4000))]
    for chunk, overlap in ((64, 1), (200, 8), (1000, 64)):
        counter = token_counts.Resynchroniser(path, chunk, overlap)
        assert counter.exact
        assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


URLS = [
    (1, None), (2, ""), (3, "no scheme.net/x"), (4, "http://a.NET/x?q#f"), (5, "https://x.example.net/en/5"), (6, "https://example.net/en"), (7, "https://badexample.net"),
    (8, "http://m.example.com/de/1"), (9, "http://org/fr/1"), (10, "http://a.org/fr/?://x.net/"), (11, "http://a.org/en/"), (11, "http://a.org/en/"), (None, "ftp://É.ORG/fr/"), (12, "http://q.com?u=/de/"), (13, "x://#://net/"),
]


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, _ in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_urls(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS verdict", "3 AS n")
    verdict = dict(url_filter.RULES)
    rows = url_filter.filter_urls(df).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter((p, *brute_url(u)) for p, u in URLS)
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in rows)
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = url_filter.filter_urls(pages).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in found) == Counter((r.page_id, *brute_url(r.url)) for r in pages.select("page_id", "url").collect())
    ruled = [r for r in found if r.rule]
    allowed = [r.score for r in ruled if r.verdict == "allow"]
    blocked = [r.score for r in ruled if r.verdict == "block"]
    assert np.mean(np.array(allowed)[:, None] > np.array(blocked)[None]) > 0.9  # the models tell ruled URLs apart


def brute_scores(urls, labels, prior=2.0):
    """Scores of ``urls`` by exact counts over the labelled URLs."""
    pairs, contexts = ([Counter(), Counter()] for _ in range(2))
    padded = lambda u: b"\x02" * 5 + u.encode()
    for u, y in labels.items():
        t = padded(u)
        for i in range(5, len(t)):
            for k in range(6):
                pairs[y][k, t[i - k : i + 1]] += 1
                contexts[y][k, t[i - k : i]] += 1
    out = []
    for u in urls:
        t, total = padded(u or ""), 0.0
        for i in range(5, len(t)):
            p = [1 / 256] * 2
            for k in range(6):
                p = [(pairs[y][k, t[i - k : i + 1]] + prior * p[y]) / (contexts[y][k, t[i - k : i]] + prior) for y in (0, 1)]
            total += np.log(p[1]) - np.log(p[0])
        out.append(total / max(1, len(t) - 5))
    return out


def test_url_scores_exact(spark):
    rng = np.random.default_rng(6)
    name = lambda: "".join(chr(x) for x in rng.integers(33, 127, 40))
    ends = ("http://x.example.net/en/", "http://m.example.com/de/", "http://a.org/en/")
    urls = [e + name() for e in ends for _ in range(3000)] + [None, "", "é://漢字"] + [ends[2] + "same"] * 50
    rows = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)).collect()
    labels = {u: int(dict(url_filter.RULES)[r] == "allow") for u in urls if u and (r := brute_url(u)[2]) and zlib.crc32(u.encode()) % 5}
    assert len(rows) == len(urls)
    some = [r for r in rows if r.page_id % 5 == 0 or r.page_id >= 9000]
    assert np.allclose([r.score for r in some], brute_scores([urls[r.page_id] for r in some], labels), atol=1e-9)
    assert len({r.score for r in rows if r.page_id >= 9003}) == 1

    # the verdict: the rule's, else the score against the threshold that best parts the ruled URLs left out of the counts
    left = {u: int(dict(url_filter.RULES)[brute_url(u)[2]] == "allow") for u in urls if u and brute_url(u)[2] and zlib.crc32(u.encode()) % 5 == 0}
    score = dict(zip(left, brute_scores(list(left), labels), strict=True))
    grid = -8 + np.arange(4001) * 16 / 4000
    cell = {u: min(3999, max(0, int(np.floor((v + 8) * 250)))) for u, v in score.items()}
    sides = [np.sort([cell[u] for u in left if left[u] == y]) for y in (0, 1)]
    right = np.searchsorted(sides[0], np.arange(1, 4001)) / len(sides[0]) + 1 - np.searchsorted(sides[1], np.arange(1, 4001)) / len(sides[1])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    threshold = (grid[best.min() + 1] + grid[best.max() + 1]) / 2
    rule = {u: brute_url(u)[2] for u in urls}
    assert all(r.verdict == (dict(url_filter.RULES)[rule[urls[r.page_id]]] if rule[urls[r.page_id]] else "allow" if r.score >= threshold else "block") for r in rows)
    assert {r.verdict for r in rows if not rule[urls[r.page_id]]} == {"allow", "block"}
