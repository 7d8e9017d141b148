"""Token counts of texts of any length: long ones are encoded in overlapping chunks that meet at proven borders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import small_batches

_META = "▁"


class Resynchroniser:
    """Counts the tokens that a SentencePiece BPE model gives a whole text, without encoding a long text at once.

    Merges never join two characters that no piece of the vocabulary holds next to each other. Between such a pair
    there is always a token border, and the tokens on either side depend on that side alone. Chunks overlap; two
    neighbours are spliced at a border that both have inside the overlap and that is proven in this way. If there is
    none, the left chunk's overlap is doubled until there is one or the text ends, so counts are always exact.
    """

    def __init__(self, model_file: str, chunk: int = 16384, overlap: int = 64) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        pairs, width = set(), np.zeros(self.model.vocab_size(), np.int64)
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                byte = int(piece[3:-1], 16)
                width[i] = 0 if byte & 0xC0 == 0x80 else 1  # a character counts at its first byte
            elif not self.model.is_control(i):
                piece = piece.replace(_META, " ")
                width[i] = len(piece)
                pairs.update(zip(piece, piece[1:], strict=False))
        self.pairs, self.width = frozenset(pairs), width
        self.exact = self._plain()

    def _plain(self) -> bool:
        """Whether the model keeps characters one to one and puts one mark in front, which the offsets rest on."""
        probe = "  a\t b\né ﬁ  "
        pieces = "".join(p for p in self.model.encode(probe, out_type=str) if not p.startswith("<0x"))
        return pieces == _META + "".join(c for c in probe.replace(" ", _META) if self.model.piece_to_id(c) != self.model.unk_id()) and not self.model.is_unknown(self.model.piece_to_id("a"))

    def starts(self, text: str, at: int) -> np.ndarray:
        """Where each token of this chunk starts in the text, of which the chunk begins at ``at``; inside of a character: -1."""
        ids = np.array(self.model.encode(text), np.int64)
        width = self.width[ids]
        begin = at - 1 + np.cumsum(width) - width
        begin[width == 0] = -1
        return begin

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.exact:
            return len(self.model.encode(text))
        text = text.replace(_META, " ")
        total, low = 0, 0  # tokens before ``low`` are counted
        at, to = 0, self.chunk
        left = self.starts(text[: to + self.overlap], 0)
        while True:
            end = min(len(text), to + self.overlap)
            if end == len(text):
                return total + self._between(left, low, end)
            right = self.starts(text[to : min(len(text), to + self.chunk + self.overlap)], to)
            widen = self.overlap
            while (border := self._border(text, left, right, to, end)) is None:
                widen *= 2
                end = min(len(text), to + widen)
                left = self.starts(text[at:end], at)
                if end == len(text):
                    return total + self._between(left, low, end)
                if end > to + self.chunk:
                    right = self.starts(text[to : min(len(text), end + self.overlap)], to)
            total += self._between(left, low, border)
            low, at, left = border, to, right
            to = max(to + self.chunk, min(end, len(text) - 1))

    @staticmethod
    def _between(starts: np.ndarray, low: int, high: int) -> int:
        """Tokens of a chunk that begin from ``low`` to before ``high``; the bytes of a character go with its first."""
        begin = np.maximum.accumulate(np.where(starts < 0, -1, starts))
        return int(((begin >= low) & (begin < high)).sum()) if low else int((begin < high).sum())

    def _border(self, text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        for p in np.intersect1d(left[(left > low) & (left < high)], right[right > low]):
            if (text[p - 1], text[p]) not in self.pairs:
                return int(p)
        return None


@lru_cache(maxsize=2)
def _resynchroniser(model_file: str, chunk: int, overlap: int) -> Resynchroniser:
    return Resynchroniser(model_file, chunk, overlap)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = 16384, overlap: int = 64) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the library's on the whole text, without begin, end or added special tokens. A null text counts as
    empty (0 bytes, 0 tokens); repeated rows each get a row; null doc_ids stay null; other columns are not read; an
    empty table gives an empty result. No shuffle; a task holds one Arrow batch and the tokens of one chunk,
    or of the longest stretch without a proven border.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _resynchroniser(model_file, chunk, overlap)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            distinct = text.dictionary_encode()  # equal texts are encoded once a batch
            each = np.array([counter.count(x) for x in distinct.dictionary.to_pylist()] or [0], np.int64)
            tokens = each[distinct.indices.to_numpy()] if len(text) else each[:0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text.cast(pa.binary())).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
