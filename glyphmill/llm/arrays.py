"""Columns of text as flat numpy arrays.

A *word* is, in the lower-cased text, a maximal run of characters that are neither ASCII other than letters and digits,
nor in U+0080-U+00BF, U+2000-U+207F or U+3000-U+303F (``WORD`` is the same rule as a regular expression). Lower-casing is
one code point to one code point, so that character positions in the lower-cased and the original text agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x00-/:-@\[-`{-\xbf\u2000-\u207f\u3000-\u303f]+"
#: The same for SQL engines whose patterns are RE2's.
WORD_RE2 = r"[^\x{00}-/:-@\[-`{-\x{bf}\x{2000}-\x{207f}\x{3000}-\x{303f}]+"

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _C1, _C2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_P_INV = U(pow(int(_P), -1, 2**64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash, and their inverses."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bits spread so that any part of them may be compared or used as an order."""
    h = h ^ (h >> U(33))
    h *= _C1
    h ^= h >> U(33)
    h *= _C2
    h ^= h >> U(33)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def large(column) -> pa.Array:
    """One large_string array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 62) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about so many bytes, and so many rows at most, each with the position of its first row; a longer text is a slice by itself."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    i = 0
    while i < len(column):
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, column.slice(i, j - i)
        i = j


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a large_string array, and where each begins (and the last ends)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: hashes, the byte where each begins and ends in ``data``, and for each text the number of words before it."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = data, offsets = flat(pc.utf8_lower(column))
        n = len(data)
        word = _IS_WORD[data]
        lead = data[:-2]
        for first, low, high in ((0xE2, 0x80, 0x82), (0xE3, 0x80, 0x81)):
            at = np.flatnonzero(lead == first)
            at = at[(data[at + 1] >= low) & (data[at + 1] < high)]
            for k in range(3):
                word[at + k] = False
        at = np.flatnonzero(data[:-1] == 0xC2)
        word[at] = word[at + 1] = False
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before &= ~edge[:n]
        after &= ~edge[1:]
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def characters(self) -> np.ndarray:
        """For each byte, the number of characters before it; one more at the end."""
        count = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=count[1:])
        return count

    def left(self) -> np.ndarray:
        """How many words remain in its text from each word on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))


def grams(hashes: np.ndarray, n: int, picks: tuple[int, ...] | None = None) -> np.ndarray:
    """A hash of the n words from each position, or of those of them that are picked; the last positions, which have fewer, are left out."""
    m = max(0, len(hashes) - n + 1)
    total = np.zeros(m, np.uint64)
    odd = _P
    for k in picks if picks is not None else range(n):
        total = total * odd + hashes[k : k + m]
    return mix(total + U(n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many consecutive values."""
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column of so many values a row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
