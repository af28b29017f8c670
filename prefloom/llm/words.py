"""Vectorised word hashing over the UTF-8 bytes of Arrow string arrays.

A word is a maximal run of "word" bytes; every byte of a non-ASCII character is either all
word or (never, in the classes used here) all separator, so byte runs equal character runs.
A-Z is lowered by table. A word's hash is a polynomial over its bytes modulo 2**64, mixed;
equal words have equal hashes in every task, and callers that need certainty compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from prefloom.llm.common import held

LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
#: decontamination words: digits, a-z and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: shingle words: everything but space and tab..carriage return
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = NONSPACE[9:14] = False

_BLOCK = 1 << 20
_LONG_WORD = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    def make() -> tuple[np.ndarray, ...]:
        a = np.full((2, _BLOCK + _LONG_WORD + 1), [[_P], [_P_INV]], dtype=np.uint64)
        a[:, 0] = 1
        return tuple(np.multiply.accumulate(a, axis=1))

    return held("powers", make)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a run of texts: ``low`` bytes, ``starts``/``ends`` byte positions in it,
    ``first[d]:first[d + 1]`` the words of text d, ``hashes`` one per word."""

    def __init__(self, low: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.low, self.offsets = low, offsets
        m = is_word[low]
        n = len(low)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begin, end = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        if n:
            begin[0], end[-1] = m[0], m[-1]
            begin[1:] = m[1:] & (~m[:-1] | edge[1:n])
            end[:-1] = m[:-1] & (~m[1:] | edge[1:n])
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        power, inverse = _powers()
        starts, ends, lo = self.starts, self.ends, 0
        while lo < len(starts):
            if ends[lo] - starts[lo] > _LONG_WORD:
                word = self.low[starts[lo] : ends[lo]].tobytes()
                out[lo] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                lo += 1
                continue
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _BLOCK, "right")))
            far = np.flatnonzero(ends[lo:hi] - starts[lo:hi] > _LONG_WORD)
            hi = lo + int(far[0]) if len(far) else hi
            at = starts[lo]
            v = _BYTE[self.low[at : ends[hi - 1]]]
            v *= power[: len(v)]
            np.add.accumulate(v, out=v)
            s, e = starts[lo:hi] - at, ends[lo:hi] - at
            below = np.where(s > 0, v[s - 1], np.uint64(0))
            out[lo:hi] = (v[e - 1] - below) * inverse[s]
            lo = hi
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


_Q = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (runs across texts included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * _Q + hashes[k : k + n]
    return mix(h + np.uint64(size))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of at most about ``most`` bytes each
    (one row at least), null as empty: bounds the arrays that the caller builds."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
