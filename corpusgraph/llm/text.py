"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

No Python loop runs over words. A word is a maximal run of ASCII letters, digits, ``_`` and
all non-ASCII characters; everything else separates words. Hashes are 64 bits wide and do not
depend on process, machine or batch borders.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_GRAM = U64(0xD6E8FEB86659FD93)

#: Class of each byte: 0 separates, other values start a new token wherever they change.
WORDS = np.zeros(256, np.uint8)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORDS[_c] = 1
WORDS[128:] = 1
#: Runs of punctuation are tokens too.
WORDS_AND_MARKS = np.where(WORDS == 1, 1, 2).astype(np.uint8)
WORDS_AND_MARKS[[9, 10, 11, 12, 13, 32]] = 0

_BLOCK = 1 << 19
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), _BLOCK + 1)
        base, inverse = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 2**64), U64)
        base[0] = inverse[0] = 1
        _pow, _inv = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _pow, _inv


@dataclass
class Words:
    hash: np.ndarray    # of each word
    first: np.ndarray   # index of each text's first word, and at the end the number of words
    start: np.ndarray   # first byte of each word in ``data``
    end: np.ndarray     # byte after it
    data: np.ndarray    # bytes of all texts
    offsets: np.ndarray  # first byte of each text, and the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(column: pa.Array, lower: bool = True) -> pa.Array:
    """The column without nulls (null: empty), in lower case if asked for."""
    column = pc.fill_null(column, "")
    return pc.utf8_lower(column) if lower else column


def _cut(data: np.ndarray, kind: np.ndarray, at: int) -> int:
    """End of a block that begins at ``at``: no token crosses it."""
    end = min(len(data), at + _BLOCK)
    while end < len(data) and kind[data[end]] and kind[data[end]] == kind[data[end - 1]]:
        end += 1
    return end


def words(texts: pa.Array, kind: np.ndarray = WORDS) -> Words:
    """Tokens of a string column without nulls; ``kind`` is a class per byte."""
    data, offsets = buffers(texts)
    return words_of(data, offsets, kind)


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORDS) -> Words:
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        to = _cut(data, kind, at)
        part, c = data[at:to], kind[data[at:to]]
        inner = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, to)] - at
        first = np.ones(len(c), bool)
        np.not_equal(c[1:], c[:-1], out=first[1:])
        first[inner] = True
        last = np.ones(len(c), bool)
        last[:-1] = first[1:]
        token = c != 0
        s, e = np.flatnonzero(first & token), np.flatnonzero(last & token) + 1
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(join(hashes, U64), np.searchsorted(start, offsets), start, join(ends, np.int64), data, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each position (also across texts: see ``gram_starts``)."""
    if len(h) < n:
        return np.zeros(0, U64)
    g = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        g *= _GRAM
        g += h[i:len(h) - n + 1 + i]
    return mix(g)


def gram_starts(w: Words, n: int) -> np.ndarray:
    """Positions at which ``n`` words of one text begin."""
    of = w.text
    return np.flatnonzero(of[:len(of) - n + 1] == of[n - 1:]) if len(of) >= n else np.zeros(0, np.int64)


def sequence_hash(w: Words) -> np.ndarray:
    """Two 64-bit hashes of each text's whole word sequence, shape (texts, 2)."""
    out = np.zeros((len(w.first) - 1, 2), U64)
    some = np.flatnonzero(w.count)
    if len(some):
        up, _ = powers(int(w.count.max()) + 1)
        place = up[np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count)]
        for k, salt in enumerate((0x1234567, 0x7654321ABCDEF)):
            out[some, k] = mix(np.add.reduceat(mix(w.hash ^ U64(salt)) * place, w.first[some]) ^ w.count[some].astype(U64))
    return out


def small(batches, column: str = "text", limit: int = 1 << 20, rows: int = 4096):
    """Parts of Arrow batches with about ``limit`` bytes of text, one text at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:at + rows]), limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
