"""Word positions and hashes of many texts at once, on Arrow buffers.

A text is handled as its UTF-8 bytes. Two word rules are in use: runs of ASCII
letters, digits and any non-ASCII character (case folded A-Z only), and runs of
anything but ASCII white space. Both are rules over bytes, since every byte of a
non-ASCII character is 128 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _table(other: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes outside the given ranges."""
    out = np.ones(256, dtype=bool)
    for low, high in other:
        out[low : high + 1] = False
    return out


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z
FOLDED = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: ``[^\x20\x09-\x0D]``
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """Bytes of consecutive rows: ``data`` and the row limits ``bounds``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = data
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lower(self) -> Texts:
        return Texts(_LOWER[self.data], self.bounds)


def text_chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, Texts]]:
    """Row ranges of a text column of about ``limit`` bytes (a longer text is a
    range of its own), each with its first row number. NULL is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        low, high = int(bounds[row]), int(bounds[end])
        yield row, Texts(data[low:high], bounds[row : end + 1] - low)
        row = end


class Words:
    """Start and end of every word, and the first word number of every row."""

    def __init__(self, texts: Texts, rule: np.ndarray):
        data, bounds = texts.data, texts.bounds
        inside = rule[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = bounds[:-1] < bounds[1:]
        opens, closes = bounds[:-1][filled], bounds[1:][filled] - 1
        first[opens] = inside[opens]
        last[closes] = inside[closes]
        self.texts = texts
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word: a polynomial over its bytes, then mixed."""
        size = len(self.texts.data)
        up = np.cumprod(np.full(size + 1, _ODD, dtype=np.uint64))
        down = np.cumprod(np.full(size + 1, _INVERSE, dtype=np.uint64))
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((self.texts.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        out = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        out ^= out >> np.uint64(29)
        out *= _MIX
        return out ^ (out >> np.uint64(32))

    def window_hashes(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hash of every ``length`` consecutive words, by its first word; windows
        may cross rows, see ``whole_windows``."""
        n = len(words) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(length):
            out *= np.uint64(_ODD)
            out += words[k : k + n]
        out ^= out >> np.uint64(31)
        out *= _MIX
        return out ^ (out >> np.uint64(33))

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, words, side="right") - 1

    def text(self, first: int, length: int) -> bytes:
        """The words from ``first``, joined by single spaces."""
        data = self.texts.data
        return b" ".join(
            data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + length)
        )
