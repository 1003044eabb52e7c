"""Vectorised scanning of many texts at once: words, word hashes, k-grams, coverage.

Texts arrive as one byte buffer plus offsets (the layout of an Arrow binary array), so no Python object
is made per word.  All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the scratch memory of one call.
BLOCK = 1 << 17

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15 | 1), _U(0xD1342543DE82EF95)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


#: One 64-bit value per byte value, by a rule (mix of the byte number).
BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]

#: Word bytes under the class [^\x20\x09-\x0D].
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes under the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; kept up to 2 BLOCK entries."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 2 * BLOCK)
        p, q = np.full(size, _BASE), np.full(size, _U(_inverse(int(_BASE))))
        p[0] = q[0] = 1
        p, q = np.cumprod(p), np.cumprod(q)
        if size > 2 * BLOCK:
            return p, q
        _powers["p"], _powers["q"] = p, q
    return _powers["p"], _powers["q"]


class Texts:
    """A byte buffer with offsets; text i is buf[off[i]:off[i + 1]]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @classmethod
    def of(cls, column) -> "Texts":
        """From an Arrow binary or string array; null reads as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
        kind = np.int64 if large else np.int32
        bufs = column.buffers()
        off = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        buf = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(column) else np.zeros(0, np.uint8)
        return cls(buf, off - off[0])

    def __getitem__(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def slices(self, size: int):
        """Runs of whole texts of about `size` bytes (one text at least): (first, Texts)."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + size, "right")) - 1)
            yield i, Texts(self.buf[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i])
            i = j


class Words:
    """Words of several texts: byte spans, the word range of each text, and hashes."""

    def __init__(self, texts: Texts, in_word: np.ndarray = NON_SPACE, value: np.ndarray = BYTE_VALUE):
        self.texts, self.value = texts, value
        on = in_word[texts.buf]
        inner = texts.off[:-1][np.diff(texts.off) > 0]
        first, last = on.copy(), on.copy()
        first[1:] &= ~on[:-1]
        last[:-1] &= ~on[1:]
        first[inner] = on[inner]
        final = texts.off[1:][np.diff(texts.off) > 0] - 1
        last[final] = on[final]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, texts.off)
        self.n = np.diff(self.off)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts.n), self.n)

    def text_end(self) -> np.ndarray:
        """The end, in words, of the text of each word."""
        return np.repeat(self.off[1:], self.n)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, through `value`."""
        return span_hashes(self.texts.buf, self.start, self.end, self.value)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Hash of each buf[start:end]; starts and ends do not fall.  Equal bytes have equal hashes anywhere."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + BLOCK, "right")))
        hi = int(end[j - 1])
        p, q = _pow(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[buf[lo:hi]] * p[: hi - lo], out=total[1:])
        s = start[i:j] - lo
        out[i:j] = (total[end[i:j] - lo] - total[s]) * q[s]
        i = j
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes (max(0, n - k + 1) values)."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out *= _STEP
        out += h[j : j + m]
    return mix(out)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window [s, s + k) of the given distinct starts."""
    d = np.zeros(n + k + 1, np.int32)
    d[starts] += 1
    d[starts + k] -= 1
    return np.cumsum(d)[:n] > 0


def counts_by(off: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Number of set flags in each range [off[i], off[i + 1])."""
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space, as an Arrow string array."""
    s, e = words.start[keep], words.end[keep]
    size = e - s + 1
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    at = np.repeat(s - (upto - size), size) + np.arange(total)
    out = words.texts.buf[np.minimum(at, len(words.texts.buf) - 1)] if total else np.zeros(0, np.uint8)
    out[upto - 1] = 32
    ends = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts_by(words.off, keep))))]
    some = np.diff(ends) > 0
    solid = np.ones(total, bool)
    solid[ends[1:][some] - 1] = False
    off = ends - np.concatenate(([0], np.cumsum(some)))
    return strings(out[solid], off)


def strings(buf: np.ndarray, off: np.ndarray, kind=None) -> pa.Array:
    """An Arrow string (or `kind`) array over a buffer."""
    return pa.Array.from_buffers(kind or pa.string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
