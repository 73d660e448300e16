"""Vectorised kernels over the UTF-8 bytes of a column of texts.

A chunk of texts is one byte array with offsets. A word is a maximal run of bytes other than 0x20 and
0x09-0x0D; continuation bytes are never white space, so that byte-wise and code-point-wise words agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and ASCII punctuation as white space.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n, kept and doubled as texts get longer."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step % (1 << 64)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunk:
    """Bytes of some texts, null as empty, with the offsets of each text."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None, latin: bool = False):
        """table: what each byte is read as, such as LOWER. latin: lower-case U+00C0 to U+00DE as well."""
        column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
        wide = pa.types.is_large_string(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if latin and len(data):
            high = np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
            data = data + (high * np.uint8(0x20)).astype(np.uint8)
        self.data, self.offsets, self.n = (data if table is None else table[data]), offsets - offsets[0], len(column)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """The number of marked bytes of each text."""
        return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[self.offsets])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and the index of each text's first word (one more entry at the end)."""
        inside = ~SPACE[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial hash; one more entry than bytes."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(TABLE[self.data] * powers(BASE, len(self.data)), out=out[1:])
        return out

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
        prefix = self.prefix() if prefix is None else prefix
        back = powers(INVERSE, len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, with offsets by text. A text of fewer words gives its whole sequence as one."""
    n_words = np.diff(first)
    total = len(hashes)
    rolled = np.zeros(total, np.uint64)
    for j in range(k):
        rolled[: max(0, total - k + 1)] *= np.uint64(0xD6E8FEB86659FD93)
        rolled[: max(0, total - k + 1)] += hashes[j : j + max(0, total - k + 1)]
    rolled = mix(rolled)
    valid = np.zeros(total + 1, np.int64)
    np.add.at(valid, first[:-1][n_words >= k], 1)
    np.add.at(valid, (first[1:] - k + 1)[n_words >= k], -1)
    keep = np.cumsum(valid[:-1]) > 0
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    for i in short:
        h = np.uint64(n_words[i])
        with np.errstate(over="ignore"):
            for x in hashes[first[i] : first[i + 1]]:
                h = mix(np.array([h * np.uint64(0xA24BAED4963EE407) + x]))[0]
        rolled[first[i]] = h
        keep[first[i]] = True
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    return rolled[keep], np.concatenate([[0], np.cumsum(counts)])
