"""Fill-in-middle: an index of distinct texts with their token borders, from which every document takes its own cut."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from plotloom.llm.common import give_back, small_batches, text_slices, word_bounds

#: Marks before prefix, suffix and middle: fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text with more documents than this is joined in parts; so there are at most rows / HOT such texts, which bounds what is broadcast.
HOT = 16_384
#: Neighbouring rows of a scan whose equal texts travel as one row.
RUN = 2_048


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing list of numbers: ``low`` has the last ``bits`` bits of each, ``high`` the rest as unary gaps, a one for each number."""

    n: int
    bits: int
    low: bytes
    high: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"")
        bits = max(0, int(values[-1] // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits)) & 1
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(-(-(int(ones[-1]) + 1) // 64) * 64, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def dump(self) -> bytes:
        return struct.pack("<QBQ", self.n, self.bits, len(self.low)) + self.low + self.high

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, bits, size = struct.unpack_from("<QBQ", data)
        return cls(n, bits, data[17 : 17 + size], data[17 + size :])

    def select(self, places: Sequence[int]) -> list[int]:
        """The numbers at ``places``: the place of the k-th one among the high bits, found by the ones before each word of 64 bits, and the low bits beside it."""
        words = np.frombuffer(self.high, np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        out = []
        for k in places:
            word = int(np.searchsorted(before, k, "right")) - 1
            inside = np.flatnonzero(np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little"))[k - before[word]]
            at = k * self.bits
            part = int.from_bytes(self.low[at // 8 : (at + self.bits + 7) // 8], "little") >> at % 8 & (1 << self.bits) - 1
            out.append((64 * word + int(inside) - k) << self.bits | part)
        return out


def borders(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of UTF-8 texts the ends of its tokens, in code points: the ends of its words, and its own if it ends with white space."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    _, ends, row = word_bounds(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        own = ends[first[i] : first[i + 1]]
        if b > a and not (len(own) and own[-1] == b):
            own = np.append(own, b)
        yield points[own] - points[a]


def draw(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the sha256 of ``seed:doc_id``; a null doc_id has no digits there."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def arrange(text: str, doc_id: int | None, n: int, index: EliasFano, seed: int, rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, code points of prefix and middle, output) of one document."""
    h1, h2, h3, h4 = draw(doc_id, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (index.select([c - 1])[0] if c else 0 for c in cuts)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        return "spm", first, second - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", first, second - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def text_groups(texts: DataFrame) -> DataFrame:
    """(key, docs, text) of the distinct texts of (key, text): key is the SHA-256 of a text, docs the number of its rows.

    Rows of a key are grouped by their content, not by the key alone: each distinct text of a key is kept while counting, before the
    shuffle and after, and two of them under one key are an error instead of a wrong group.
    """
    grouped = texts.groupBy("key").agg(F.collect_set("text").alias("texts"), F.count("*").alias("docs"))
    return grouped.select("key", "docs", F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("different texts have the same key"))).alias("text"))


@F.arrow_udf(BinaryType())
def border_list(texts: pa.Array) -> pa.Array:
    """The borders of each text as an Elias-Fano list."""
    out = [EliasFano.of(x).dump() for _, data, offsets in text_slices(texts) for x in borders(data, offsets)]
    give_back()
    return pa.array(out, pa.binary())


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, hot: int = HOT) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n, form, prefix_chars, middle_chars and output.

    A text is cut into n tokens: white space (0x20, 0x09 to 0x0D) and the word after it, and white space at the end by itself. The
    sha256 of ``seed:doc_id`` picks two of the n + 1 borders and the form: plain (the text, where it is empty or holds a
    mark, or by chance in 100 - ``rate`` of 100 cases), spm in ``spm`` of 100 cases, else psm.

    Distinct texts are grouped by content, and the borders of each are listed once, as an Elias-Fano list; doc_ids join texts and lists by
    key, and each document selects its two borders. Whole texts travel once, in partial groups: the lists are made of them and sent by themselves, as
    Spark doesn't know how rows lie behind Python, and the joins take the texts as they lie. Neighbouring rows with equal
    texts travel as one list of at most ``RUN`` doc_ids. A text of more than ``hot`` documents is dealt, with its list, to a part for
    each ``hot`` of them; at most rows / ``hot`` keys are broadcast for that.

    A null text is empty; a null doc_id stays null and is drawn as no digits; repeated rows and doc_ids each get a row; other columns are not
    read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), F.lit(b"")).alias("key")  # never null, which spares a filter that hashes again
    runs = rows.select("doc_id", key, F.floor(F.monotonically_increasing_id() / RUN).alias("run")).groupBy("key", "run").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    large = runs.groupBy("key").agg(F.sum(F.size("ids")).alias("docs")).where(F.col("docs") > hot).select("key", F.ceil(F.col("docs") / hot).alias("parts"))
    listed = runs.join(F.broadcast(large), "key", "left")  # at most rows / hot keys
    groups = text_groups(rows.select(key, "text"))

    def index(own: DataFrame) -> DataFrame:
        return own.select("key", "docs", "text").join(own.select("key", border_list("text").alias("index")).hint("merge"), "key")

    few = index(groups.where(F.col("docs") <= hot)).join(listed.where("parts IS NULL").select("key", "ids").hint("merge"), "key")
    parts = index(groups.where(F.col("docs") > hot)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("docs") / hot) - 1)))
    dealt = listed.where("parts IS NOT NULL").select("key", "ids", F.pmod(F.xxhash64("run"), F.col("parts")).alias("part"))
    many = parts.join(dealt.hint("merge"), ["key", "part"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        for b in batches:
            for text, dumped, ids in zip(b.column("text"), b.column("index"), b.column("ids"), strict=True):
                text, own = text.as_py(), EliasFano.load(dumped.as_py())
                for i in ids.as_py():
                    out.append((i["doc_id"], own.n, *arrange(text, i["doc_id"], own.n, own, seed, rate, spm)))
                    size += len(text) + 64
                    if size > 1 << 20:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()
        give_back()

    found = few.select("text", "index", "ids").unionByName(many.select("text", "index", "ids"))
    return found.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. No text with a mark is ever cut, so the first mark of each kind is the one that was put."""
    body = F.substr(output, F.lit(4))
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.substr(body, F.lit(1), F.position(second, body) - 1)
    rest = F.substr(body, F.length(one) + 4)
    two = F.substr(rest, F.lit(1), F.position(F.lit(MIDDLE), rest) - 1)
    middle = F.substr(rest, F.length(two) + 4)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def digests(filled: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with output and the text restored from it as SHA-256 digests."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
