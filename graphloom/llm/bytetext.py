"""Vectorised reading of texts inside tasks: words, word hashes and shingles of a batch of texts at once.

A batch is a byte array and the offsets of its texts, as Arrow stores strings.
All hashes are of 64 bits and depend on the bytes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hashes of overlapping spans are polynomials modulo this prime.
_PRIME = (1 << 61) - 1
_BASE = 0x15D1_9A3B_7C24_E6F7 % _PRIME
_INVERSE = pow(_BASE, -1, _PRIME)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}
#: Bytes whose products with the halves of a power are summed without passing 64 bits.
_RUN = 1 << 22
#: Spans of more bytes are hashed one by one.
_LONG = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any x of 64 bits."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 32 bits; 2 ** 61 is 1."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    middle, least = a1 * b0 + a0 * b1, a0 * b0
    middle = (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half)
    return _reduced(((a1 * b1) << np.uint64(3)) + middle + (least & np.uint64(_PRIME)) + (least >> np.uint64(61)))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo the prime, n of them at least."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, _times(have, np.uint64(pow(base, len(have), _PRIME)))])
    _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of_arrow(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without copying; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 400_000):
    """Runs of whole texts of about so many bytes: (first text, end text, bytes, offsets)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) of all words."""
    return terms(data, offsets, ~_SPACE)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base ** position up to each position, modulo the prime."""
    out = np.zeros(len(data) + 1, np.uint64)
    power = powers(_BASE, len(data))
    for a in range(0, len(data), _RUN):
        b = min(len(data), a + _RUN)
        value = data[a:b].astype(np.uint64) + np.uint64(1)
        low = np.cumsum((power[a:b] & np.uint64(0xFFFFFFFF)) * value)
        high = np.cumsum((power[a:b] >> np.uint64(32)) * value)
        high = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
        out[a + 1 : b + 1] = _reduced(_reduced(low) + high + out[a])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans may overlap."""
    sums = prefix[ends] + np.uint64(_PRIME) - prefix[starts]
    return mixed(_times(_reduced(sums), powers(_INVERSE, len(prefix))[starts]) + (ends - starts).astype(np.uint64) * _ODD)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each span, or the left ones that are fewer."""
    got = lanes[at]
    return np.where(left >= 8, got, got & _FIRST[np.minimum(left, 7)])


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span: eight bytes at a time, each step a bijection that is mixed; long spans by xxhash."""
    size = ends - starts
    h = mixed(size.astype(np.uint64) * _ODD + np.uint64(seed))
    lanes = _lanes(data)
    rows = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left, now = starts[rows], size[rows], h[rows]
    while len(rows):
        now = mixed((now ^ _lane(lanes, at, left)) * _ODD)
        more = left > 8
        h[rows[~more]] = now[~more]
        rows, at, left, now = rows[more], at[more] + 8, left[more] - 8, now[more]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes=words_hash) -> tuple[np.ndarray, np.ndarray]:
    """(a key of each span, the places of those of more than seven bytes): shorter ones are their bytes and length, so their keys tell them apart; others are hashed."""
    size = ends - starts
    lane = _lanes(data)[starts]
    keys = (lane & _FIRST[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > 7)
    keys[long] = hashes(data, starts[long], ends[long]) | np.uint64(1 << 63)
    return keys, long


def same_bytes(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, others: np.ndarray, others_end: np.ndarray) -> np.ndarray:
    """Whether each span of one holds the bytes of the span beside it of other."""
    size = ends - starts
    same = size == others_end - others
    mine, theirs = _lanes(one), _lanes(other)
    rows = np.flatnonzero(same & (size > 0) & (size <= _LONG))
    a, b, left = starts[rows], others[rows], size[rows]
    while len(rows):
        equal = _lane(mine, a, left) == _lane(theirs, b, left)
        same[rows[~equal]] = False
        more = equal & (left > 8)
        rows, a, b, left = rows[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i in np.flatnonzero(same & (size > _LONG)).tolist():
        same[i] = np.array_equal(one[starts[i] : ends[i]], other[others[i] : others_end[i]])
    return same


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    starts, ends, first = words(data, offsets)
    return words_hash(data, starts, ends), first


def terms(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first of each text and the end) of the runs of bytes that solid, a table of 256, marks."""
    inside = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1, np.searchsorted(starts, offsets)


def combined(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out + h[k : len(h) - n + 1 + k]) * _ODD
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted different hashes of each text's n-word shingles, A-Z in lower case; a shorter text is one shingle."""
    h, first = word_hashes(LOWER[data], offsets)
    all_ = combined(h, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(all_[a : b - n + 1]))
        elif b > a:
            out.append(combined(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
