"""Numpy kernels over the texts of an Arrow batch: words, their hashes, shingles and sentences, without per-word Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POW = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed and kept for the worker's life."""
    while len(_POW[0]) < n:
        for i, base in enumerate((0xD1B54A32D192ED03, pow(0xD1B54A32D192ED03, -1, 1 << 64))):
            p = _POW[i]
            _POW[i] = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    return _POW[0], _POW[1]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of several texts: start and end in buf, the text each belongs to, a 64-bit hash of each.

    separator: a table of the 256 byte values that part words. Hashes depend on the word's bytes alone."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = WHITE, lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        self.text_start = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        apart = separator[self.buf]
        change = np.flatnonzero(np.diff(apart, prepend=True))
        self.start, self.end = change[::2], change[1::2]
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.text_start)

    def prefix_hash(self, most: int) -> np.ndarray:
        return self.hash(np.minimum(self.end, self.start + most))

    def hash(self, end: np.ndarray | None = None) -> np.ndarray:
        end = self.end if end is None else end
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + _PIECE, side="right")))
            piece = self.buf[base : self.end[to - 1]]
            power, inverse = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[piece] * power[: len(piece)], out=sums[1:])
            s, e = self.start[at:to] - base, end[at:to] - base
            out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD)
            at = to
        return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of n words of one text; with fewer words, of the whole as one; none of none."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : len(hashes) - n + 1 + i] + np.uint64((i + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
    return np.unique(out)
