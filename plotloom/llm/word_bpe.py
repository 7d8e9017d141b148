"""Ids of a lower-casing BPE vocabulary with word ends, for many words at once."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from plotloom.llm.common import ragged, word_bounds

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_NONE = np.iinfo(np.int32).max


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[0x21:0x7F] = _SIGN
    out[ord("a") : ord("z") + 1] = _LETTER
    out[ord("A") : ord("Z") + 1] = _LETTER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("'")] = _OTHER  # contractions are left to the library
    return out


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes like ``tokenizers.Tokenizer.from_file(path)`` without added tokens, several times as fast on running text.

    White space parts words, and no merge crosses it, so each distinct word of a batch is encoded once. Words of ASCII and
    Latin-1 letters, digits and signs are cut into the units of the vocabulary's split pattern here, and the merges of all
    units of one length run side by side in arrays. Any other word (apostrophes, other scripts, combining marks, control
    characters, the start of a special token's string, very long units) goes to the library itself.
    """

    LONGEST = 48

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in _byte_characters()], np.int64)
        self.last = np.array([vocab[c + end] for c in _byte_characters()], np.int64)
        self.classes = _byte_classes()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = slot + 1 & (1 << self.bits) - 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank
        self.known: dict[bytes, np.ndarray] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20 | right).ravel()
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], _NONE).astype(np.int32)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slots[todo] = slots[todo] + 1 & (1 << self.bits) - 1
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(left.shape)

    def _merge(self, ids: np.ndarray, rows: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Merges the lowest-ranked pair of each row, leftmost first, until no row has one; out: (rows, ids) of equal lengths."""
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n = ids.shape[1]
            if n == 1:
                out.append((rows, ids))
                return
            at = ranks.argmin(1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            go = best < _NONE
            if not go.all():
                out.append((rows[~go], ids[~go]))
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                every = every[: len(rows)]
            if not len(rows):
                return
            step = np.arange(n - 1)
            ids = np.take_along_axis(ids, step + (step > at[:, None]), 1)
            ids[every, at] = self.result[best]
            step = step[:-1]
            if n == 2:
                out.append((rows, ids))
                return
            ranks = np.take_along_axis(ranks, step + (step >= at[:, None]), 1)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < n - 2)
            ranks[after, at[after]] = self._rank(ids[after, at[after]], ids[after, at[after] + 1])

    def _of_library(self, word: bytes) -> np.ndarray:
        if (ids := self.known.get(word)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            ids = self.known[word] = np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, np.int64)
        return ids

    def _units(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids one after another) of distinct units."""
        own = ~foreign & (lengths <= self.LONGEST)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths[own]):
            rows = np.flatnonzero(own & (lengths == n))
            for k in range(0, len(rows), 100_000):
                some = rows[k : k + 100_000]
                text = data[starts[some, None] + np.arange(n)]
                self._merge(np.concatenate([self.inner[text[:, :-1]], self.last[text[:, -1:]]], 1), some, parts)
        for i in np.flatnonzero(~own):
            parts.append((np.array([i]), self._of_library(data[starts[i] : starts[i] + lengths[i]].tobytes())[None]))
        counts = np.zeros(len(starts), np.int64)
        for rows, ids in parts:
            counts[rows] = ids.shape[1]
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        for rows, ids in parts:
            if ids.shape[1]:
                flat[first[rows, None] + np.arange(ids.shape[1])] = ids
        return counts, flat

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each row, ids one after another) of UTF-8 rows."""
        n = len(offsets) - 1
        starts, ends, row = word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(n, np.int64), np.zeros(0, np.int64)
        kind = self.classes[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        text = data.copy()
        capital = (data >= 0x41) & (data <= 0x5A)
        capital[lead + 1] = data[lead + 1] <= 0x9E
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        kind[special] = _OTHER
        odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        foreign = odd[ends] > odd[starts]

        inside = kind != _SPACE
        whose = np.zeros(len(data), bool)  # bytes of foreign words
        whose[ragged(starts[foreign], (ends - starts)[foreign])] = True
        text[capital & ~whose] += 0x20
        begin = np.zeros(len(data), bool)
        begin[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & inside[1:] & ~whose[1:]
        begin[starts] = True
        kept = np.flatnonzero(inside)
        at = np.flatnonzero(begin[kept])
        packed = text[kept]
        bounds = np.append(at, len(kept)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        code = units.indices.to_numpy()
        each = units.dictionary
        bounds_u = np.frombuffer(each.buffers()[1], np.int64)[each.offset : each.offset + len(each) + 1]
        data_u = np.frombuffer(each.buffers()[2], np.uint8)
        seen = np.zeros(len(each), np.int64)
        seen[code] = kept[at]
        counts, flat = self._units(data_u, bounds_u[:-1], np.diff(bounds_u), whose[seen])
        first = np.cumsum(counts) - counts
        ids = flat[ragged(first[code], counts[code])]
        of = np.searchsorted(offsets, kept[at], "right") - 1
        return np.bincount(of, counts[code], n).astype(np.int64), ids


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
