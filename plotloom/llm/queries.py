"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plotloom.llm import elkan, fill_middle, forest, language_crf, line_quality, mixing, packing, secret_scan, sharding, simhash, suffix_dedup, token_counts, url_filter
from plotloom.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over ``documents``; its docstrings say what each does with nulls, ties and empty tables."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language, op3_token_counts, op4_url_filter, op5_simhash, op6_forest, op7_mix_sources, op8_pack, op9_jump_shards, op10_line_quality, op11_fill_middle, op12_elkan, op13_secret_scan, pipeline)}


_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n FROM documents),
o AS (SELECT doc_id, n, j, substr(h, 1000 * j + 1, 1098) o FROM (SELECT doc_id, h, n, unnest(range(0, (n + 499) // 500)) j FROM d)),
s AS (SELECT doc_id, 500 * j + q AS p, substr(o, 2 * q + 1, 100) w FROM (SELECT doc_id, j, o, unnest(range(0, least(500, n - 49 - 500 * j))) q FROM o WHERE n - 49 - 500 * j > 0)),
m AS (SELECT w, min(doc_id) f FROM s GROUP BY w),
g AS (SELECT DISTINCT doc_id, p + k AS q FROM (SELECT s.doc_id, s.p FROM s JOIN m USING (w) WHERE f < s.doc_id), range(50) t(k)),
r AS (SELECT doc_id, count(*) n_removed, count(*) FILTER (NOT coalesce(q - 1 = before, FALSE)) n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) before FROM g) GROUP BY 1),
b AS (SELECT doc_id, 500 * j + i AS q, substr(o, 2 * i + 1, 2) c FROM (SELECT doc_id, j, o, unnest(range(0, least(500, n - 500 * j))) i FROM o JOIN r USING (doc_id))),
k AS (SELECT doc_id, string_agg(c, '' ORDER BY q) kept FROM b ANTI JOIN g USING (doc_id, q) GROUP BY 1)
SELECT d.doc_id, n::BIGINT n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(CASE WHEN r.doc_id IS NULL THEN unhex(h) ELSE unhex(coalesce(kept, '')) END) kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(words) - 1)) i, unnest(list_transform(list_zip(words[1:len(words) - 2], words[2:len(words) - 1], words[3:len(words)]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) w FROM d WHERE len(words) > 2),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) n FROM t) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) n_repeat_words FROM x, range(3) r(k) GROUP BY 1),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) line FROM d),
n AS (SELECT doc_id, source, text, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM l),
h AS (SELECT source, array_to_string(w, ' ') line, count(DISTINCT text) n FROM n WHERE len(w) > 0 GROUP BY ALL),
z AS (SELECT source, count(DISTINCT text) documents FROM d GROUP BY 1),
bad AS (SELECT h.source, line FROM h JOIN z ON h.source IS NOT DISTINCT FROM z.source WHERE h.n >= 10 AND h.n > 0.03 * documents),
gone AS (SELECT n.doc_id, sum(len(n.w))::BIGINT gone FROM n JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND array_to_string(n.w, ' ') = bad.line GROUP BY 1),
c AS (SELECT doc_id, len(words)::BIGINT n_words, coalesce(list_sum(list_transform(words, lambda v: length(v))), 0)::BIGINT word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
(len(list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')))))::BIGINT n_dup_lines,
coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, gone FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - coalesce(gone, 0) AS words_left FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (gone IS NOT NULL AND (words_left < 0.5 * n_words OR words_left < 50)) AS kept, words_left FROM f
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
r AS (SELECT *, len(w) n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) a, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) b, ('0x' || substr(h, 17, 8))::BIGINT % 100 c, ('0x' || substr(h, 25, 8))::BIGINT % 100 e FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END form,
array_to_string(w[1:least(a, b)], '') p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') m, array_to_string(w[greatest(a, b) + 1:n], '') s FROM r)
SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) output_sha256, sha256(t) restored_sha256 FROM f
"""


def _op12(rounds: int = 10, clusters: int = 8) -> str:
    """Lloyd's rounds, one after another, with all distances."""
    near = "SELECT r, vec_id, x, arg_min(cluster, (d, cluster)) cluster, min(d) d FROM (SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT d FROM v, {c}) GROUP BY ALL"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS y FROM (SELECT x, sha256('3:' || coalesce(vec_id::VARCHAR, '')) h FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.y, c.y) y FROM c{i} c LEFT JOIN (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY p) y FROM "
            f"(SELECT cluster, p, sum(x[p])::BIGINT s, count(*)::BIGINT n FROM a{i}, range(1, 65) t(p) GROUP BY 1, 2) GROUP BY 1) m ON c.cluster = m.cluster)"
        )
    parts.append(f"z AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, z.cluster::INT AS cluster, d::BIGINT distance, (sum(d) OVER (PARTITION BY z.cluster))::BIGINT cluster_inertia, (sum(d) OVER ())::BIGINT inertia, "
        f"sha256(array_to_string(y, ',')) centroid_sha256, count(*) OVER (PARTITION BY z.cluster) size FROM z JOIN c{rounds} c ON z.cluster = c.cluster"
    )


def _op13() -> str:
    cased = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(cased(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = (f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9+/_-]{20,}={0,2}")
    matches = " UNION ALL ".join(
        f"SELECT r, source, lang, {k} k, unnest(range(1, len(m) + 1)) i, unnest(m) m, unnest(v) v, unnest(g[1:len(m)]) g FROM (SELECT r, source, lang, regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {2 if k == 0 else 0}) v, string_split_regex(t, '{p}') g FROM d)"
        for k, p in enumerate(patterns)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(source, '~') source, coalesce(lang, '~') lang, coalesce(text, '') t FROM documents),
x AS ({matches}),
y AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) e FROM x),
b AS (SELECT r, k, e - length(m) a, e FROM y WHERE k < 3 AND (k > 0 OR length(v) >= 12)),
c AS (SELECT DISTINCT r, source, lang, v, e - length(v) a, e FROM y WHERE (k > 0 OR length(v) >= 12) AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 8),
o AS (SELECT v, count(DISTINCT source) <= 2 AND count(DISTINCT (source, lang)) <= 3 AS own FROM c GROUP BY v),
w AS (SELECT r, a, e, own FROM c JOIN o USING (v)),
s AS (SELECT r, count(*) FILTER (k = 0) n0, count(*) FILTER (k = 1) n1, count(*) FILTER (k = 2) n2, string_agg(z, ',' ORDER BY a, k, e) FILTER (k < 3) base, string_agg(z, ',' ORDER BY a, k, e) FILTER (k < 3 OR own) spans, count(*) FILTER (k = 3 AND own) owned, count(*) FILTER (k = 3 AND NOT own) examples
FROM (SELECT *, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || a || ':' || e z FROM (SELECT r, k, a, e, NULL own FROM b UNION ALL SELECT r, 3, a, e, own FROM w)) GROUP BY r)
SELECT doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(owned, 0) owned, coalesce(examples, 0) examples FROM d LEFT JOIN s USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """The others rest on trained models, hashes or tokenizers, which SQL can't express; tests/llm holds them against brute force."""
    return {"op1_suffix_dedup": _OP1, "op10_line_quality": _OP10, "op11_fill_middle": _OP11, "op12_elkan": _op12(), "op13_secret_scan": _op13()}
