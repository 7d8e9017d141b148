"""Language identification by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import WORD, give_back, mix64, ragged, small_batches, text_slices, unique_words, word_bounds

_BEGIN, _END = 2, 3
_CHUNK = 64


def word_features(words: Sequence[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """See features_of."""
    return features_of(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64), bits)


def features_of(data: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first feature of each word and the end, hashed features): the word itself (lexicon), its affixes and its inner n-grams.

    n-grams have 2 to 4 bytes of the word with a mark at either end; one that holds a mark is an affix and hashed apart. The words stand one after
    another in ``data``.
    """
    words, sizes = len(lengths), lengths + 2
    ends = np.cumsum(sizes)
    marked = np.full(int(sizes.sum()), _END, np.uint8)
    marked[ends - sizes] = _BEGIN
    marked[ragged(ends - sizes + 1, lengths)] = data
    begin = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(words), sizes)
    wide = marked.astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    parts, owner = [], []
    code = wide.copy()
    for n in (2, 3, 4):
        if len(marked) < n:
            break
        code = code[: len(marked) - n + 1] << np.uint64(8) | wide[n - 1 :]
        ok = word[: len(code)] == word[n - 1 :]
        affix = (marked[: len(code)] == _BEGIN) | (marked[n - 1 :] == _END)
        parts.append((mix64(code + np.uint64(n << 40) + affix.astype(np.uint64) * np.uint64(1 << 44)) & mask)[ok])
        owner.append(word[: len(code)][ok])
    powers = np.uint64(0x100000001B3)
    place = np.arange(len(marked)) - np.repeat(begin, sizes)
    whole = np.add.reduceat(mix64(wide + place.astype(np.uint64) * powers), begin) if words else np.zeros(0, np.uint64)
    parts.append(mix64(whole + np.uint64(7)) & mask)
    owner.append(np.arange(words))
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=words))]), np.concatenate(parts)[order].astype(np.int64)


@dataclass
class Crf:
    """labels: the languages, ascending. weights: (features, labels) emission scores. moves: (labels, labels) transition scores."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    bits: int

    @classmethod
    def fit(cls, texts: Sequence[tuple[str, list[bytes]]], bits: int = 17, epochs: int = 4, rate: float = 0.3, segment: int = 12, segments: int = 4, seed: int = 5) -> Crf:
        """AdaGrad on the conditional log-likelihood of code-switched sequences: segments of labelled texts, put together at random."""
        labels = sorted({y for y, _ in texts})
        out = cls(labels, np.zeros((1 << bits, len(labels))), np.zeros((len(labels), len(labels))), bits)
        pieces = [(labels.index(y), w[k : k + segment]) for y, w in texts for k in range(0, len(w), segment)]
        if not pieces:
            return out
        words, code = np.unique(np.array([w for _, p in pieces for w in p], object), return_inverse=True)
        first, features = word_features(list(words), bits)
        sizes = np.array([len(p) for _, p in pieces])
        starts = np.cumsum(sizes) - sizes
        truth = np.array([y for y, _ in pieces])
        rng = np.random.default_rng(seed)
        heat_w, heat_m = np.full_like(out.weights, 1e-6), np.full_like(out.moves, 1e-6)
        batch = 64
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            order = order[: len(order) // segments * segments] if len(order) >= segments else order
            for at in range(0, len(order), batch * segments):
                rows = order[at : at + batch * segments]
                flat = code[ragged(starts[rows], sizes[rows])]
                y = np.repeat(truth[rows], sizes[rows])
                lengths = np.add.reduceat(sizes[rows], np.arange(0, len(rows), segments))
                counts = first[flat + 1] - first[flat]
                used = features[ragged(first[flat], counts)]
                score = np.add.reduceat(out.weights[used], np.cumsum(counts) - counts)
                marginal, pairs = out.forward_backward(score, lengths, pairs=True)
                marginal[np.arange(len(y)), y] -= 1
                inner = np.ones(len(y), bool)
                inner[np.cumsum(lengths)[:-1]] = inner[0] = False
                np.subtract.at(pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
                cells, where = np.unique(used, return_inverse=True)
                step = np.stack([np.bincount(where, np.repeat(marginal[:, k], counts), len(cells)) for k in range(len(labels))], 1) / len(lengths)
                heat_w[cells] += step**2
                out.weights[cells] -= rate * step / np.sqrt(heat_w[cells])
                pairs = pairs / len(lengths) + 1e-3 * out.moves
                heat_m += pairs**2
                out.moves -= rate * pairs / np.sqrt(heat_m)
        out.weights = out.weights.astype(np.float32)  # 4 bytes a cell on each executor
        return out

    def emissions(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first, features = features_of(data, lengths, self.bits)
        return np.add.reduceat(self.weights[features], first[:-1], dtype=np.float64) if len(lengths) else np.zeros((0, len(self.labels)))

    def forward_backward(self, score: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(words, labels) posterior marginals of sequences laid end to end, and the expected transitions if asked for.

        Sequences are cut into chunks of 64 words, and all chunks run side by side: first each chunk's transfer matrix, then the
        messages from chunk to chunk along each sequence, then the words inside. A sequence's first word has no transition.
        """
        labels = len(self.labels)
        move = np.exp(self.moves - self.moves.max())
        emit = np.exp(score - score.max(1, keepdims=True)) + 1e-30
        per = -(-lengths // _CHUNK)
        total = int(per.sum())
        begin = np.cumsum(lengths) - lengths
        rank = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(begin, per) + rank * _CHUNK
        size = np.minimum(_CHUNK, np.repeat(begin + lengths, per) - start)
        deep = int(size.max(initial=0))
        some = [np.flatnonzero(size > t) for t in range(deep)]
        whole = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for t, own in enumerate(some):
            step = (whole[own] if t == 0 else whole[own] @ move) * emit[start[own] + t][:, None, :]
            if t == 0:
                later = rank[own] > 0
                step[later] = move * emit[start[own][later]][:, None, :]
            whole[own] = step / step.sum((1, 2), keepdims=True)
        head, tail = np.full((total, labels), 1 / labels), np.full((total, labels), 1 / labels)
        first = np.cumsum(per) - per
        for k in range(1, int(per.max(initial=0))):
            to = first[per > k] + k
            message = np.einsum("ci,cij->cj", head[to - 1], whole[to - 1])
            head[to] = message / message.sum(1, keepdims=True)
            to = (first + per)[per > k] - 1 - k
            message = np.einsum("cij,cj->ci", whole[to + 1], tail[to + 1])
            tail[to] = message / message.sum(1, keepdims=True)
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        now = head.copy()
        for t, own in enumerate(some):
            entered = now[own] @ move
            if t == 0:
                entered[rank[own] == 0] = 1 / labels
            step = entered * emit[start[own] + t]
            now[own] = forward[start[own] + t] = step / step.sum(1, keepdims=True)
        now = tail.copy()
        for t in range(deep - 1, -1, -1):
            own = some[t]
            backward[start[own] + t] = now[own]
            step = (now[own] * emit[start[own] + t]) @ move.T
            now[own] = step / step.sum(1, keepdims=True)
        marginal = forward * backward
        marginal /= marginal.sum(1, keepdims=True)
        if not pairs:
            return marginal, None
        inner = np.ones(len(emit), bool)
        inner[begin[lengths > 0]] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] * move * (emit[at] * backward[at])[:, None, :]
        return marginal, (joint / joint.sum((1, 2), keepdims=True)).sum(0)

    def label_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, marginals) of the words with a letter of UTF-8 rows."""
        starts, ends, row = word_bounds(data, offsets)
        if not len(starts):
            return row, starts, ends, np.zeros((0, len(self.labels)))
        code, words = unique_words(data, starts, ends)
        body, sizes, lettered = plain_words(words)
        keep = lettered[code]
        starts, ends, row, code = starts[keep], ends[keep], row[keep], code[keep]
        if not len(starts):
            return row, starts, ends, np.zeros((0, len(self.labels)))
        if not self.labels:
            return row, starts, ends, np.zeros((len(row), 0))
        score = self.emissions(body, sizes)[code]
        lengths = np.bincount(row, minlength=len(offsets) - 1)
        marginal, _ = self.forward_backward(score, lengths[lengths > 0])
        return row, starts, ends, marginal


    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language or ``und``, score, words with a letter, changes of label) of each UTF-8 row; see identify."""
        n = len(offsets) - 1
        predicted, score, count, switches = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if self.labels:
            row, _, _, marginal = self.label_words(data, offsets)
            count = np.bincount(row, minlength=n).astype(np.int64)
            sums = np.stack([np.bincount(row, marginal[:, k], n) for k in range(len(self.labels))], 1)
            best = sums.argmax(1)
            has = count > 0
            predicted[has] = np.array(self.labels, object)[best[has]]
            score[has] = np.clip(sums[has, best[has]] / count[has], 0, 1)
            word = marginal.argmax(1)
            change = (row[1:] == row[:-1]) & (word[1:] != word[:-1])
            switches = np.bincount(row[1:][change], minlength=n).astype(np.int64)
        return predicted, score, count, switches


_LOWER = np.zeros(256, np.uint8)  # of ASCII letters
_LOWER[ord("a") : ord("z") + 1] = _LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def plain_words(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes one after another, lengths, whether there is a letter) of the words as ``plain`` gives them; ASCII words are done as one array."""
    n = len(words)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low = _LOWER[data]
    spots = np.flatnonzero(low)
    letters, foreign = (np.concatenate([[0], np.cumsum(x)]) for x in (low > 0, data >= 0x80))
    own = foreign[bounds[1:]] == foreign[bounds[:-1]]
    first, last = letters[bounds[:-1]], letters[bounds[1:]]
    lettered = last > first
    start, stop = np.zeros(n, np.int64), np.zeros(n, np.int64)  # from the first letter to the last
    start[lettered], stop[lettered] = spots[first[lettered]], spots[last[lettered] - 1] + 1
    rest = np.flatnonzero(~own)
    texts = [w.decode() for w in words.take(pa.array(rest)).to_pylist()]
    others = [plain(w) for w in texts]
    lettered[rest] = [any(map(str.isalpha, w)) for w in texts]
    lengths = stop - start
    lengths[rest] = [len(w) for w in others]
    begin = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    from_ = ragged(start[own], lengths[own])
    out[ragged(begin[own], lengths[own])] = np.where(low[from_] > 0, low[from_], data[from_])
    out[ragged(begin[rest], lengths[rest])] = np.frombuffer(b"".join(others), np.uint8)
    return out, lengths, lettered


def plain(word: str) -> bytes:
    """A word in lower case, without what isn't a letter at its ends."""
    if not word.isalpha():
        low, high = 0, len(word)
        while low < high and not word[low].isalpha():
            low += 1
        while high > low and not word[high - 1].isalpha():
            high -= 1
        word = word[low:high]
    return word.lower().encode()


def _fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4, F.lit(-1))


def _learnable(docs: DataFrame) -> DataFrame:
    """(lang, h, text) of the rows that may be learned from; h is a hash of the text below 2**31."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 2))
    return rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("h"), "text")


def learn(docs: DataFrame, documents: int = 300, words: int = 128, total: int = 20_000, weights_mb: int = 64) -> Crf:
    """A model from at most ``documents`` distinct texts of each language, the smallest by hash, and a window of at most ``words`` words of each.

    Only rows with a language whose crc32(doc_id) mod 4 is 0, 1 or 3 are learned from. The number of distinct texts of each language, however often they
    repeat, says up to which hash about twice as many as wanted lie; those come to the driver, which takes the smallest. So no task meets a whole language, a text's
    copies meet as one, and a language of few texts is learned from all of them.

    The sample has bounds: ``total`` texts are wanted in all, so many languages get fewer each, one at least; beyond ``total`` languages
    those with the most distinct texts are learned. The weights, which go to all executors, take ``weights_mb`` MB at most: beyond 128 languages features share
    cells. A null lang, text or doc_id isn't learned from; an empty table gives a model without languages.
    """
    rows = _learnable(docs)
    distinct = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))  # kept in registers: no text and no hash travels
    counts = distinct.orderBy(F.desc("n"), "lang").limit(total).collect()  # at most ``total`` rows
    if not counts:
        return Crf.fit([])
    wanted = max(1, min(documents, total // len(counts)))
    cuts = docs.sparkSession.createDataFrame([(r.lang, min(1 << 31, (2 * wanted + 20 << 31) // max(1, r.n))) for r in counts], "lang string, cut long")
    picked = rows.join(F.broadcast(cuts), "lang").where("h < cut")  # a row a language
    listed = picked.select("lang", "h", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all"))
    begin = F.pmod(F.col("h"), F.greatest(F.size("all") - words, F.lit(0)) + 1).cast("int") + 1
    found = listed.select("lang", "h", F.slice("all", begin, words).alias("words")).groupBy("lang", "h").agg(F.min("words").alias("words")).collect()
    found.sort(key=lambda r: (r.lang, r.h))
    kept, seen = [], Counter()
    for r in found:
        if seen[r.lang] < wanted:
            seen[r.lang] += 1
            kept.append((r.lang, [plain(w) for w in r.words if any(map(str.isalpha, w))]))
    cells = max(1, (weights_mb << 20) // (4 * len(counts)))
    return Crf.fit(kept, bits=min(17, cells.bit_length() - 1))


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per document of (doc_id, text, lang): doc_id, held_out, lang_pred, score, n_labelled and n_switches.

    The model labels every word of the whole text; lang_pred is the language with the largest mean marginal over the words
    with a letter (ties to the first by name), score that mean. ``und`` with score 0 stands for a null text or one without
    letters, or if there is nothing to learn from. held_out: crc32(doc_id as text) mod 4 is 2; such rows, rows without
    lang, text or doc_id, and all sources and doc_ids, never reach the model. n_switches counts neighbouring words with
    different labels.

    Repeated rows each get a row; a null doc_id stays null and isn't held out; other columns are not read; an empty table
    gives an empty result. No shuffle of texts but of the bounded training sample.
    """
    crf = learn(docs) if model is None else model
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # at most weights_mb of ``learn``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at, data, offsets in text_slices(b.column("text"), slice_bytes(len(own.labels))):
                n = len(offsets) - 1
                found = own.documents(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, n), b.column("held_out").slice(at, n), *map(pa.array, found)], ["doc_id", "held_out", "lang_pred", "score", "n_labelled", "n_switches"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold(F.col("doc_id")) == 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_labelled long, n_switches long")


def slice_bytes(labels: int) -> int:
    """Bytes of text that are labelled together: a chunk of 64 words has a matrix of labels ** 2 numbers, so many labels need shorter slices."""
    return max(1 << 14, (1 << 18) * 64 // max(64, labels**2))


def lettered_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each UTF-8 row has a letter."""
    letters = np.concatenate([[0], np.cumsum(_LOWER[data] > 0)])
    out = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return out


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that have no language, and with a language for those that name none.

    Rejected are those that ``identify`` calls ``und``: texts that are null or have no letter. A code-switched text in which no language has half of
    the words stays. A document whose lang is null gets ``lang_pred`` of ``identify``, learned from ``docs`` as there; a lang that is
    given stays as it is, so such texts meet a test for letters only. If there is nothing to learn from, a null lang stays. Without a column
    lang, documents are only rejected. Repeated rows, null doc_ids and extra columns of any name stay as they are; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    crf = learn(docs) if "lang" in columns and docs.where("lang IS NULL").limit(1).count() else Crf.fit([])
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # at most weights_mb of ``learn``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at, data, offsets in text_slices(b.column("text"), slice_bytes(len(own.labels))):
                kept = pa.array(lettered_rows(data, offsets))
                part = b.slice(at, len(kept)).filter(kept)
                if own.labels:
                    place = columns.index("lang")
                    none = part.column(place).is_null()
                    found = [x for _, d, o in text_slices(part.column("text").filter(none), slice_bytes(len(own.labels))) for x in own.documents(d, o)[0]]
                    lang = pc.replace_with_mask(part.column(place), none, pa.array(found, part.schema.field(place).type))
                    part = part.set_column(place, "lang", lang)
                yield part
        give_back()

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, docs.schema)
