"""Secrets in texts: patterns, and how many owners over the whole corpus hold the same credential. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotloom.llm.common import durable

#: Kinds in their order in results. The patterns of the first three, and the least sizes of what they find.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no longer one, so the sizes of these stand in the patterns.
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"
LEAST_VALUE = 12
#: Other strings that may be credentials: long runs of what keys are written in.
OTHER = "[A-Za-z0-9+/_-]{20,}+={0,2}"


def _looks_live(value: Column, least_distinct: int) -> Column:
    """A letter, a digit, and ``least_distinct`` different characters: not a word, a number or a filler such as XXXX."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= least_distinct)


def _found(text: Column, kind: int, pattern: str, least_distinct: int) -> Column:
    """The matches in their order: code points between it and the one before, its own, those of its value (its tail), and what is kept of the value: whether
    it may be live, and its digest."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else matches
    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))

    def one(x: Column, i: Column) -> Column:
        least = LEAST_VALUE if kind == 0 else 0
        live = (F.length(x["value"]) >= least) & _looks_live(x["value"], least_distinct)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), x["gap"].alias("gap"), F.length(x["match"]).alias("size"), F.length(x["value"]).alias("value"),
            F.when(live, F.md5(F.encode(x["value"], "UTF-8"))).alias("digest"),
        )

    listed = F.transform(F.filter(zipped, lambda x: x["match"].isNotNull()), one)
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,value:int,digest:string>>"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", most_owners: int = 2, most_repositories: int = 3, least_distinct: int = 8) -> DataFrame:
    """One row per document of (doc_id, text, owner, repository): doc_id, spans, owned and examples.

    spans holds structs of start, kind, end (code points, end exclusive; kind is a place in ``KINDS``), sorted. The base kinds are
    leftmost matches that don't overlap within a kind: assign (of which the second group must have 12 characters), access and hex. Every value
    of those, and every other long string, that looks like a key (``_looks_live``) is a candidate. A repository is an owner's part with one value of
    ``repository``. A candidate that at most ``most_owners`` owners and ``most_repositories`` repositories of the whole corpus
    hold is specific to its owner: its span is added as ``live``, once for each place. One that more hold is a copied example and adds nothing.
    owned and examples count a document's candidates, by place, of either sort.

    Texts are read once and never moved: matches travel as numbers and MD5 digests, no value does. A digest's rows are first
    reduced to distinct (digest, owner, repository), so one that a third of all rows hold costs a row a task; digests that are specific join back under
    adaptive execution, which splits a hot one. Positions are running sums within a document.

    A null text is empty; a null owner or repository is one of its own; a null doc_id stays null; repeated rows and ids are separate rows (and
    witnesses of the same owner); other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_found(text, k, p, least_distinct) for k, p in enumerate((ASSIGN, ACCESS, HEX, OTHER))))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))  # noqa: E731  null apart from all texts
    base = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(owner).alias("owner"), mark(repository).alias("repository"), found.alias("found")).withColumn("row", F.monotonically_increasing_id()))

    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = base.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    matches = durable(each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).drop("gap", "place"))

    spans = matches.where((F.col("kind") < 3) & ((F.col("kind") > 0) | (F.col("value") >= LEAST_VALUE))).select("row", (F.col("end") - F.col("size")).alias("start"), "kind", "end", F.lit(0).alias("live"))
    candidates = matches.where("digest IS NOT NULL").select("row", "digest", "owner", "repository", (F.col("end") - F.col("value")).alias("start"), "end")
    owned = (
        candidates.select("digest", "owner", "repository").distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    specific = durable(owned.where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("digest"))
    judged = candidates.join(specific.withColumn("live", F.lit(1)).hint("merge"), "digest", "left").select("row", "start", "end", F.coalesce("live", F.lit(0)).alias("live"))
    added = judged.select("row", "start", F.lit(3).alias("kind"), "end", F.col("live"))

    span = F.struct(F.col("start").cast("int").alias("start"), "kind", F.col("end").cast("int").alias("end"), "live")
    listed = spans.unionByName(added).groupBy("row").agg(F.collect_set(span).alias("all"))
    out = base.select("row", "doc_id").join(listed.hint("merge"), "row", "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:int,kind:int,end:int,live:int>>"))
    count = lambda live: F.size(F.filter(every, lambda s: (s["kind"] == 3) & (s["live"] == live))).cast("long")
    kept = F.transform(F.array_sort(F.filter(every, lambda s: (s["kind"] < 3) | (s["live"] == 1))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return out.select("doc_id", kept.alias("spans"), count(1).alias("owned"), count(0).alias("examples"))


def digests(scanned: DataFrame) -> DataFrame:
    """The rows of ``scan_secrets`` with counts a base kind, the digest of the base spans, and all spans as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select("doc_id", of(0), of(1), of(2), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "owned", "examples")
