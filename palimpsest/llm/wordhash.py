"""Words and hashes of many texts at once, in numpy over Arrow's own buffers.

A word is `[^\\x20\\x09-\\x0D]+`; a null text has none. Hashes are polynomials modulo 2**64 with odd bases, so that the hash of any span
comes from two prefix sums; finish() mixes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xD6E8FEB86659FD93
BASE_WORD = 0xA0761D6478BD642F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = _SPACE.copy()
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def finish(x: np.ndarray) -> np.ndarray:
    """The mixing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; n of them."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        if len(found) <= 1 << 21:
            _powers[base] = found
    return found[:n]


class Spans:
    """Hashes of any spans of a sequence."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        self.base = base
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed: good for looking up, not for choosing by size."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finish((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Words:
    """Where the words of some texts lie (bytes start to end) and their hashes; first[d] to first[d + 1] are those of text d.
    lower: A-Z in small letters; marks_part: ASCII characters that are no letters or digits part words too."""

    def __init__(self, texts: pa.Array, lower: bool = False, marks_part: bool = False) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.zeros(0, dtype=np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        self.offsets = offsets - low
        self.bytes = np.diff(self.offsets)
        inside = ~(_MARKS if marks_part else _SPACE)[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return Spans(self.raw.astype(np.uint64) + np.uint64(1), BASE_WORD).hash(self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each n-word window. A text with fewer words, but some, has one: all its words."""
        starts = np.arange(len(hashes))
        ends = np.repeat(self.first[1:], self.counts)
        whole = starts + n <= ends
        short = (starts == np.repeat(self.first[:-1], self.counts)) & ~whole
        at = np.flatnonzero(whole | short)
        spans = Spans(hashes, BASE)
        return spans.hash(at, np.minimum(at + n, ends[at])), np.repeat(np.arange(len(self.counts)), self.counts)[at]


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with little text (or one row), so that numpy's arrays stay small."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
