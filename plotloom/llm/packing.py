"""Hierarchical packing: documents into windows of several lengths, the gaps of long ones filled from shorter tiers."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import give_back, small_batches, text_slices
from plotloom.llm.word_bpe import WordBpe, word_bpe

TIERS = (256, 512, 1024, 2048)
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step long"
_END = 1


def pack(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(window, [(document, start, length), ...]) for each sequence; the pieces fill the window from 0.

    A document gives full windows of the longest tier, and its rest is routed to the shortest tier that holds it. From
    the longest tier down, each rest opens a window of its tier. A gap takes whole rests of the longest shorter tier that
    fits; when none fits, a rest of the shortest tier that has any is cut to fill it, and what is left of that rest is routed
    again. Every window is full but the one open when nothing is left.
    """
    tiers = sorted(tiers)
    top = tiers[-1]
    pools: dict[int, deque[tuple[int, int, int]]] = {t: deque() for t in tiers}
    out = []

    def route(piece: tuple[int, int, int]) -> None:
        pools[next(t for t in tiers if piece[2] <= t)].append(piece)

    for i, n in enumerate(lengths):
        full = n // top * top
        out.extend((top, [(i, k, top)]) for k in range(0, full, top))
        if n > full:
            route((i, full, n - full))
    for window in reversed(tiers):
        pool = pools[window]
        while pool:
            piece = pool.popleft()
            pieces, gap = [piece], window - piece[2]
            while gap:
                fits = next((t for t in reversed(tiers) if t <= gap and pools[t]), None)
                if fits:
                    more = pools[fits].popleft()
                else:
                    some = next((t for t in tiers if t <= window and pools[t]), None)
                    if some is None:
                        break
                    more = pools[some].popleft()
                    if more[2] > gap:
                        route((more[0], more[1] + gap, more[2] - gap))
                        more = (more[0], more[1], gap)
                pieces.append(more)
                gap -= more[2]
            out.append((window, pieces))
    return out


def _encoded(bpe: WordBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, ids one after another), encoded in slices, as the work arrays are many times as large as the text."""
    parts = [bpe.encode(data, offsets) for _, data, offsets in text_slices(texts)]
    return np.concatenate([tokens for tokens, _ in parts]), np.concatenate([ids.astype("<u4") for _, ids in parts])


def step_groups(sizes: np.ndarray, step_tokens: int) -> np.ndarray:
    """A training step for each sequence: longest first, dealt there and back, so that steps get equal numbers of each length."""
    steps = max(1, -(-int(sizes.sum()) // step_tokens))
    turn, place = np.divmod(np.arange(len(sizes)), steps)
    out = np.empty(len(sizes), np.int64)
    out[np.argsort(-sizes, kind="stable")] = np.where(turn % 2, steps - 1 - place, place)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, tiers: Sequence[int] = TIERS, step_tokens: int = 16384, slice_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window and step.

    A document is its ids by the tokenizer file, then id 1; a null or empty text is id 1 alone. Documents are packed
    within runs of about ``slice_bytes`` of text of an input partition, each run leaving at most one window that isn't full, so the
    padding stays under one window a run whatever the input's size, and nothing is shuffled. step numbers balanced groups of
    sequences within a run, of about ``step_tokens`` tokens.

    Repeated rows and doc_ids are separate documents; null doc_ids stay null; other columns are not read; an empty table
    gives an empty result. A text longer than a run is a run of its own.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
        """(doc_ids, texts) of about ``slice_bytes`` of text, gathered over as many batches as that takes."""
        names, texts, held = [], [], 0
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text"), slice_bytes):
                if held and held + len(data) > slice_bytes:
                    yield names, pa.concat_arrays(texts)
                    names, texts, held = [], [], 0
                names += batch.column("doc_id").slice(at, len(offsets) - 1).to_pylist()
                texts.append(batch.column("text").slice(at, len(offsets) - 1))
                held += len(data) + len(offsets)
        if names:
            yield names, pa.concat_arrays(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        part = TaskContext.get().partitionId() << 33
        sequence = step = 0
        for names, texts in runs(batches):
            tokens, ids = _encoded(bpe, texts)
            sizes = tokens + 1
            begin = np.cumsum(sizes) - sizes
            whole = np.full(int(sizes.sum()), _END, "<u4")
            inner = np.ones(len(whole), bool)
            inner[begin + tokens] = False
            whole[inner] = ids
            packed = pack(sizes.tolist(), tiers)
            used = np.array([sum(p[2] for p in pieces) for _, pieces in packed])
            steps = step_groups(used, step_tokens)
            rows = []
            for k, (window, pieces) in enumerate(packed):
                place = 0
                for i, start, length in pieces:
                    low = int(begin[i]) + start
                    rows.append((names[i], start, length, zlib.crc32(whole[low : low + length]), int(sizes[i]), part + sequence + k, place, window, part + step + int(steps[k])))
                    place += length
            sequence += len(packed)
            step += int(steps.max()) + 1
            for low in range(0, len(rows), 50_000):
                columns = list(zip(*rows[low : low + 50_000], strict=True))
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
