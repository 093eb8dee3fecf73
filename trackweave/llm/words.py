"""Words and word windows of many texts at once, as 64-bit fingerprints computed on whole Arrow buffers.

A batch of texts is one run of UTF-8 bytes. Word bounds are found with a
lookup table, fingerprints with running sums of a polynomial modulo 2^64 over
table values of the bytes, so that no text is handled alone. Fingerprints
depend on nothing but the word (or window) and ``seed``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; only bounds the temporary arrays.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1

# White space (space, tab to carriage return).
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (a public finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base & MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def byte_values(seed: int, lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(seed * 1000 + 1))


@dataclass
class Words:
    """The words of a batch in order. ``starts`` and ``ends`` are byte positions in ``data``."""

    data: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each document: its first word; one more entry at the end

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        values, out = byte_values(seed, lower), np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.starts, begin + BLOCK)))
            block = self.data[begin:self.ends[to - 1]]
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(values[block] * powers(BASE, len(block)), out=sums[1:])
            s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
            out[at:to] = (sums[e] - sums[s]) * powers(INVERSE, len(block))[s]
            at = to
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def cut(texts: pa.Array) -> Words:
    """The words of every text; a NULL text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    black = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(black & (np.concatenate(([True], ~black[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(black & (np.concatenate((~black[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(at, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(data, doc, starts, ends, first)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of k words inside one document, and the word each begins at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = 0xD6E8FEB86659FD93
    if k <= 8:
        factor = powers(base, k)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += hashes[i:i + n] * factor[i]
    else:
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
        total = (sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n)
    inside = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(total[inside]), inside
