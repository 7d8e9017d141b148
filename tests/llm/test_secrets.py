"""Secret scans against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from plotloom.llm import secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LONG = "the quick brown fox jumps " * 4000 + "é漢\U0001f600" * 3000


def found(text):
    """(base spans, candidates) by start, kind and end."""
    base, candidates = [], []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, m.end()))
            candidates.append((m.start(2), m.end(), m[2]))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16), (3, "[A-Za-z0-9+/_-]{20,}={0,2}", 20)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                candidates.append((m.start(), m.end(), m[0]))
                if k < 3:
                    base.append((m.start(), k, m.end()))
    live = [(a, b, v) for a, b, v in candidates if re.search("[A-Za-z]", v) and re.search("[0-9]", v) and len(set(v)) >= 8]
    return base, live


def brute(rows, most_owners=2, most_repositories=3):
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, text, lang, source in rows:
        for _, _, v in found(text or "")[1]:
            owners[v].add(source)
            repositories[v].add((source, lang))
    out = Counter()
    for doc_id, text, _, _ in rows:
        base, live = found(text or "")
        own = {(a, b) for a, b, v in live if len(owners[v]) <= most_owners and len(repositories[v]) <= most_repositories}
        shown = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        kinds = Counter(k for _, k, _ in base)
        others = {(a, b) for a, b, _ in live} - own
        out[doc_id, kinds[0], kinds[1], kinds[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + [(a, 3, b) for a, b in own]), len(own), len(others)] += 1
    return out


def rows_of(seed):
    rng = random.Random(seed)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHJKLMNP234567") for _ in range(16)) for _ in range(12)] + [hashlib.sha1(bytes([k])).hexdigest() for k in range(12)]
    keys += ["k9_" + "".join(rng.choice("abcdefGHIJ0123456789+/") for _ in range(30)) + "=" * (k % 3) for k in range(8)]
    parts = ["password=", "Token : '", 'api_key" = "', "SECRET==", "passwd:", "apikey=token:", " é漢\U0001f600 ", "\n", "plain words here", "AKIASHORT", "deadbeef", "a" * 20, "X" * 40, "1234567890" * 3, "password=secret=abcdef123456789 ", "token=ſecretKey12345678"]
    out = [(i if i % 9 else None, "".join(rng.choice(parts if rng.random() < 0.6 else keys) + rng.choice(["", " ", ".", "'"]) for _ in range(rng.randint(0, 9))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    out += [(1, None, None, None), (2, "", "en", "a"), (3, LONG + f"password={keys[0]} " + LONG, "en", "a"), (4, " ".join(f"token={k}" for k in keys) * 30, "en", "b"), (5, "password=only0held1by2this3owner", "en", "a"), (5, "password=only0held1by2this3owner", "en", "a")]
    return out


def test_secrets(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS row", "2 AS found", "3 AS digest", "4 AS kind", "5 AS owner", "6 AS repository")
    got = Counter(tuple(r) for r in secret_scan.digests(secret_scan.scan_secrets(df)).collect())
    want = brute(rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert any("live" in r[5] for r in got) and any(r[7] for r in got)
    got = Counter(tuple(r) for r in secret_scan.digests(secret_scan.scan_secrets(df, most_owners=4, most_repositories=9)).collect())
    assert got == brute(rows, 4, 9)
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows_of(2)[:20], "doc_id long, text string, lang string, source string")
    assert not re.search("Python|Pandas|Arrow", secret_scan.digests(secret_scan.scan_secrets(df))._jdf.queryExecution().toString())
