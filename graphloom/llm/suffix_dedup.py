"""Operator 4, suffix-array deduplication: difference-cover blockwise construction.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller key. The suffixes are sorted one bucket at a time:

1. Buckets. The least of the ``gram``-byte strings within a suffix's first
   ``length`` bytes, by hash, names its bucket, so suffixes that agree so far are
   in one bucket. Neighbouring suffixes mostly share it: such a run moves as one
   piece of text. Equal runs of a batch are brought to those of the smallest key
   before they move; the others go at once.
2. Sorting. A string around a gram has half of its other bytes, rounded up, on one
   side: a bucket leaves out runs that share the gram with so many bytes on a side
   with no other document, and takes the rest in blocks of bounded bytes. In a block, the suffixes at a
   difference cover modulo 7 are ranked first, by doubling. Then every suffix is
   compared by the fewer than 7 bytes up to a cover position and the rank there,
   cut to what is left of ``length``: any two suffixes have a cover position at
   the same distance, so ties of any length are resolved by the ranks.
3. Documents meet the suffixes that go, and lose their bytes.

Hashes only deal out work; bytes decide what is equal. Buckets and blocks have
bounded bytes, their number follows the size of the input. A bucket's rows are
folded as they come: equal runs are merged, and a gram that stands in more than
``hot`` different runs leaves the bucket and is compared by rows, a row for each
suffix, summed before the shuffle.

Defined results: a null or empty text, or one under ``length`` bytes, loses
nothing; documents of one key do not remove each other's bytes; a null key
counts as larger than all others; repeated rows have equal results; an empty
table gives an empty result; texts of any length are cut into pieces with
overlap; keys are whole numbers, others are refused; columns other than key and
text are not read, whatever their names; a character that is cut in part is left
out of the text that is kept (not of the digest, which is of bytes).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytetext
from graphloom.llm.common import partitions_for, read, written

#: Bits of a position within a piece; the rest of a 64-bit number is for the hash that is smallest.
_POSITION = 21
#: Bytes of text that a task works on at once.
_BATCH = 4_000_000
_NO_KEY = np.iinfo(np.int64).max
#: A difference cover: every difference modulo PERIOD is one of two of these residues.
PERIOD, COVER = 7, (0, 1, 3)
BLOCKS = "bucket int, payload binary"
#: What leaves a bucket: blocks of (key, mark, start, end) for documents, or, without a bucket, runs of hot grams.
FOUND = "bucket int, payload binary, key long, mark long, start long, windows long, bytes binary"


def _packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, 5))


def _unpacked(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def _blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["bucket", "payload"])


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (bytetext.mixed(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each slice, one slice after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int = 1_000_000) -> np.ndarray:
    """The slices of data one after the other, about step bytes at a time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // step)) + 1
    parts = [data[_spread(b, n)] for b, n in zip(np.split(begin, cuts), np.split(size, cuts), strict=True)]
    return np.concatenate(parts)


def _grouped(items: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its items in order) for each group."""
    if not len(items):
        return
    order = np.argsort(group, kind="stable")
    values, at = np.unique(group[order], return_index=True)
    for v, part in zip(values.tolist(), np.split(items[order], at[1:]), strict=True):
        yield v, part


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator]]:
    """(bucket, its payloads one by one) of rows sorted by bucket."""
    rows = ((b, p) for batch in batches for b, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
    for bucket, group in groupby(rows, key=lambda r: r[0]):
        yield bucket, (_unpacked(p.as_py()) for _, p in group)


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks with those of a bucket together; each bucket is worked off by itself."""
    return blocks.repartition(max(buckets, partitions_for(blocks.sparkSession)), "bucket").sortWithinPartitions("bucket")


def _keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_KEY).to_numpy(zero_copy_only=False)


def _marks(data: np.ndarray, offsets: np.ndarray, marked: bool) -> np.ndarray:
    """A hash of each text, to tell apart texts of one key; zeros if no key is repeated."""
    if not marked:
        return np.zeros(len(offsets) - 1, np.int64)
    return bytetext.span_hash(bytetext.prefix_hash(data), offsets[:-1], offsets[1:]).view(np.int64)


def _intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that meet or overlap, from any."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


# --- runs -----------------------------------------------------------------------------------------------------------


class Runs:
    """The runs of a batch of texts, in order: text, start in the text, suffixes, place of the gram, its hash, a hash of the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> None:
        parts = []
        for i, _, piece, at in bytetext.pieces(data, offsets):
            if len(piece) < 1 << _POSITION:
                parts.append(self._of(piece, at, i, 0, length, gram))
            else:  # one long text: its suffixes in turn
                step = (1 << _POSITION) - 2 * length
                parts += [self._of(piece[c : c + step + length - 1], np.array([0, min(step + length - 1, len(piece) - c)]), i, c, length, gram) for c in range(0, len(piece) - length + 1, step)]
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.text, self.start, self.windows, self.place, self.sample, self.whole = (
            np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)
        )

    @staticmethod
    def _of(data: np.ndarray, offsets: np.ndarray, text: int, shift: int, length: int, gram: int) -> tuple:
        n = len(data) - length + 1
        if n <= 0:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        prefix = bytetext.prefix_hash(data)
        at = np.arange(len(data) - gram + 1)
        h = bytetext.span_hash(prefix, at, at + gram)
        low = np.uint64((1 << _POSITION) - 1)
        least = (h & ~low) | at.astype(np.uint64)
        width, reach = length - gram + 1, 1
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        sample = (least & low).astype(np.int64)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        good = of[:n] == of[length - 1 :]
        new = good.copy()
        new[1:] &= (sample[1:] != sample[:-1]) | ~good[:-1]
        start = np.flatnonzero(new)
        stop = np.flatnonzero(np.concatenate([new | ~good, [True]]))
        end = stop[np.searchsorted(stop, start, "right")]
        whole = bytetext.span_hash(prefix, start, end + length - 1)
        return of[start] + text, start - offsets[of[start]] + shift, end - start, sample[start] - start, h[sample[start]], whole


def leads(data: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: np.ndarray, key: np.ndarray, step: int = 1_000_000) -> np.ndarray:
    """For each run the run of equal bytes that has the smallest key; kind is a hash of the bytes. About step bytes are compared at once."""
    order = np.lexsort((key, kind))
    first = np.ones(len(order), bool)
    first[1:] = kind[order][1:] != kind[order][:-1]
    lead = np.arange(len(order))
    if len(order):
        lead[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = np.flatnonzero((lead != np.arange(len(lead))) & (size == size[lead]))
    lead[(lead != np.arange(len(lead))) & (size != size[lead])] = -1
    for some in np.split(other, np.flatnonzero(np.diff(np.cumsum(size[other]) // step)) + 1) if len(other) else ():
        n = size[some]
        at = _spread(begin[some], n)
        equal = np.logical_and.reduceat(data[at] == data[at + np.repeat(begin[lead[some]] - begin[some], n)], np.cumsum(n) - n)
        lead[some[~equal]] = -1
    return np.where(lead < 0, np.arange(len(lead)), lead)


@dataclass
class Pieces:
    """Different runs of texts (their bytes, a hash of these, gram and key), and where each stands: run, mark and start. All places of a run are of its key.

    left and right are hashes of the gram with the bytes on a side of it, 0 where the run has too few.
    """

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    sample: np.ndarray
    left: np.ndarray
    right: np.ndarray
    key: np.ndarray
    of: np.ndarray
    mark: np.ndarray
    start: np.ndarray

    @staticmethod
    def joined(parts: list[Pieces]) -> Pieces:
        runs, data = np.cumsum([0, *[len(p.size) for p in parts]]), np.cumsum([0, *[len(p.data) for p in parts]])
        cat = lambda f: np.concatenate([f(k, p) for k, p in enumerate(parts)])
        plain = {c: cat(lambda _, p, c=c: getattr(p, c)) for c in ("data", "size", "kind", "sample", "left", "right", "key", "mark", "start")}
        return Pieces(begin=cat(lambda k, p: p.begin + data[k]), of=cat(lambda k, p: p.of + runs[k]), **plain)

    def some(self, runs: np.ndarray) -> Pieces:
        """These runs alone."""
        to = np.full(len(self.size), -1)
        to[runs] = np.arange(len(runs))
        held = np.flatnonzero(to[self.of] >= 0)
        plain = [getattr(self, c)[runs] for c in ("begin", "size", "kind", "sample", "left", "right", "key")]
        return Pieces(self.data, *plain, to[self.of[held]], self.mark[held], self.start[held])

    def packed(self) -> Pieces:
        """The runs with their bytes one after the other, and no others."""
        return replace(self, data=_gather(self.data, self.begin, self.size), begin=np.cumsum(self.size) - self.size)

    def merged(self) -> tuple[Pieces, list[np.ndarray]]:
        """Runs of different bytes, and (key, mark, start, end) of those that go, as a run of a smaller key has their bytes."""
        lead = leads(self.data, self.begin, self.size, self.kind, self.key)
        less = self.key[self.of] > self.key[lead[self.of]]
        at = np.flatnonzero(less)
        gone = [self.key[self.of[at]], self.mark[at], self.start[at], self.start[at] + self.size[self.of[at]]]
        stay = np.flatnonzero(~less)
        held = replace(self, of=lead[self.of[stay]], mark=self.mark[stay], start=self.start[stay])
        return held.some(np.flatnonzero(lead == np.arange(len(lead)))), gone

    def may_repeat(self) -> np.ndarray:
        """The runs that have a gram and the bytes on a side of it in common with a run of another key, gram by gram."""
        shares = np.zeros(len(self.key), bool)
        for side in (self.left, self.right):
            order = np.argsort(side)
            if len(order):
                first = np.concatenate([[0], np.flatnonzero(side[order][1:] != side[order][:-1]) + 1])
                key = self.key[order]
                several = np.minimum.reduceat(key, first) < np.maximum.reduceat(key, first)
                shares[order[np.repeat(several & (side[order[first]] != 0), np.diff(np.append(first, len(order))))]] = True
        runs = np.flatnonzero(shares)
        return runs[np.argsort(self.sample[runs], kind="stable")]


def deal_runs(docs: DataFrame, length: int, gram: int, buckets: int, doc_buckets: int, marked: bool) -> DataFrame:
    """Blocks of runs by gram, and of runs already known to go by document (their bucket is -1 - the document's)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _keys(batch.column(0))
            for i, j, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(1)), _BATCH):
                if rows := dealt(every[i:j], data, offsets):
                    yield _blocks(rows)

    def dealt(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
        marks = _marks(data, offsets, marked)
        runs = Runs(data, offsets, length, gram)
        key, begin, size = keys[runs.text], offsets[runs.text] + runs.start, runs.windows + length - 1
        lead = leads(data, begin, size, runs.whole, key)
        gone = np.flatnonzero(key > key[lead])
        start, end = _intervals(begin[gone], begin[gone] + size[gone])
        text = np.searchsorted(offsets, start, "right") - 1
        # intervals are cut where texts end
        ends = np.searchsorted(offsets, end, "left") - 1
        n = ends - text + 1
        of = _spread(text, n)
        start, end = np.maximum(np.repeat(start, n), offsets[of]) - offsets[of], np.minimum(np.repeat(end, n), offsets[of + 1]) - offsets[of]
        rows = _gone_blocks([keys[of], marks[of], start, end], doc_buckets, -1)
        bucket = (runs.sample % np.uint64(buckets)).astype(np.int64)
        places = dict(_grouped(np.flatnonzero(key == key[lead]), bucket[key == key[lead]]))  # of a run's smallest key
        own = np.flatnonzero(lead == np.arange(len(lead)))
        number = np.full(len(lead), -1)
        for to, run in _grouped(own, bucket[own]):
            number[run] = np.arange(len(run))
            flat = data[_spread(begin[run], size[run])].tobytes()
            at = places[to]
            texts, which = np.unique(runs.text[at], return_inverse=True)
            plain = [number[lead[at]], which, runs.start[at], runs.windows[run], runs.place[run], np.diff(keys[texts], prepend=0), marks[texts]]
            rows.append((to, _packed(flat, *[_narrow(x) for x in plain])))
        return rows

    return docs.mapInArrow(deal, BLOCKS)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(x) or x.min() >= 0 and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _gone_blocks(columns: list[np.ndarray], doc_buckets: int, sign: int = 1) -> list[tuple[int, bytes]]:
    """Blocks of (key, mark, start, end) by document; with sign -1, a bucket is -1 - the document's."""
    bucket = _bucket_of(columns[0] ^ columns[1], doc_buckets)
    return [(b if sign > 0 else -1 - b, _packed(*[c[i] for c in columns])) for b, i in _grouped(np.arange(len(columns[0])), bucket)]


def _pieces_of(payload: tuple, length: int, gram: int) -> Pieces:
    of, which, start, windows, place, steps, marks = (x.astype(np.int64) for x in payload[1:])
    data = np.frombuffer(payload[0], np.uint8)
    size = windows + length - 1
    begin = np.cumsum(size) - size
    prefix = bytetext.prefix_hash(data)
    place += begin
    end = begin + size
    aside = (length - gram + 1) // 2  # of a string's bytes beside the gram so many stand on one side at least
    sample, whole = (bytetext.span_hash(prefix, a, b) for a, b in ((place, place + gram), (begin, end)))
    far = np.maximum(place - aside, 0)
    left = np.where(place - aside >= begin, bytetext.span_hash(prefix, far, place + gram) | np.uint64(1), np.uint64(0))
    far = np.minimum(place + gram + aside, len(data))
    right = np.where(place + gram + aside <= end, bytetext.span_hash(prefix, place, far) | np.uint64(1), np.uint64(0))
    key = np.zeros(len(size), np.int64)
    key[of] = np.cumsum(steps)[which]
    return Pieces(data, begin, size, whole, sample, left, right, key, of, marks[which], start)


# --- the suffixes of a block ----------------------------------------------------------------------------------------


def cover_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, order, common) of the suffixes at the difference cover: sorted by their first depth bytes, and how many bytes, depth at most, each shares with the one before.

    data ends with depth + 8 bytes that are no text. Ranks are doubled: a cover position and the one a multiple of PERIOD on are in one residue.
    """
    n = len(data) - depth - 8
    per = len(COVER)
    p = (np.arange(-(-n // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
    p = p[p < n]
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    name = key = view[p].astype(np.uint64)
    order = np.argsort(key)
    reach = 8
    while True:
        ranked = key[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if reach >= depth:
            break
        name = np.empty(len(order), np.uint64)
        name[order] = np.cumsum(new)
        step = reach // PERIOD
        after = np.zeros(len(name), np.uint64)
        after[: max(0, len(name) - per * step)] = name[per * step :]
        key = (name << np.uint64(32)) | after
        order = np.argsort(key)
        reach += PERIOD * step
    common = np.full(len(order), -1)
    alive = np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = view[p[order[alive]] + k].astype(np.uint64) ^ view[p[order[alive - 1]] + k].astype(np.uint64)
        same = sum((differ < np.uint64(1 << 8 * (8 - b))).astype(np.int64) for b in range(1, 8)) + (differ == 0)
        common[alive] = k + same
        alive = alive[same == 8]
    return p, order, np.minimum(common, depth)


def suffixes_that_go(block: Pieces, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, suffix of the run) for the suffixes whose first length bytes also start in a run of a smaller key."""
    data = np.concatenate([block.data, np.zeros(length + 8, np.uint8)])
    windows = block.size - length + 1
    at = _spread(block.begin, windows)
    run = np.repeat(np.arange(len(windows)), windows)
    _, rank = np.unique(block.key, return_inverse=True)
    rank = rank.astype(np.int32)[run]
    _, order, common = cover_order(data, length)
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    gone = np.zeros(len(at), bool)
    residue = at % PERIOD
    index = np.full(PERIOD, -1)
    index[list(COVER)] = np.arange(len(COVER))
    for ahead in range(PERIOD):  # a cover position is so many bytes on
        name = np.empty(len(order), np.uint64)
        name[order] = np.cumsum(common < length - ahead)
        meets = np.zeros(PERIOD, bool)
        meets[[(c - ahead) % PERIOD for c in COVER]] = True
        some = np.flatnonzero(meets[residue] & ~gone)
        if len(some) < 2:
            continue
        p = at[some] + ahead
        names = name[p // PERIOD * len(COVER) + index[p % PERIOD]]
        if not ahead:
            by = np.argsort(names)
            new = names[by][1:] != names[by][:-1]
        else:
            head = view[at[some]].astype(np.uint64) >> np.uint64(64 - 8 * ahead)
            if len(order).bit_length() + 8 * ahead <= 64:
                names = (names << np.uint64(8 * ahead)) | head
                by = np.argsort(names)
                new = names[by][1:] != names[by][:-1]
            else:
                by = np.lexsort((head, names))
                new = (names[by][1:] != names[by][:-1]) | (head[by][1:] != head[by][:-1])
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        own = rank[some[by]]
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(by))))
        gone[some[by[own > least]]] = True
    found = np.flatnonzero(gone)
    return run[found], at[found] - block.begin[run[found]]


def places_that_go(block: Pieces, length: int) -> list[np.ndarray]:
    """(key, mark, start, end) for the bytes of a block that go."""
    run, suffix = suffixes_that_go(block, length)
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (suffix[1:] != suffix[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(run) - 1)[: len(first)]
    run, start, end = run[first], suffix[first], suffix[last] + length
    n = np.bincount(run, minlength=len(block.size))
    low = np.cumsum(n) - n
    place = np.repeat(np.arange(len(block.of)), n[block.of])
    at = _spread(low[block.of], n[block.of])
    return [block.key[block.of[place]], block.mark[place], block.start[place] + start[at], block.start[place] + end[at]]


def sort_buckets(blocks: DataFrame, length: int, gram: int, buckets: int, doc_buckets: int, bucket_bytes: int, block_bytes: int, hot: int) -> DataFrame:
    """FOUND: what goes, by document, and the runs of hot grams."""
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), *[(c, pa.int64()) for c in ("key", "mark", "start", "windows")], ("bytes", pa.binary())])

    def rows_of(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
        made = _blocks(blocks)
        return pa.RecordBatch.from_arrays([*made.columns, *[pa.nulls(len(made), f.type) for f in list(schema)[2:]]], schema=schema)

    def hot_rows(p: Pieces) -> pa.RecordBatch:
        n = len(p.of)
        size = p.size[p.of]
        flat = _gather(p.data, p.begin[p.of], size)
        strings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(flat)])
        plain = [pa.array(x) for x in (p.key[p.of], p.mark, p.start, size - length + 1)]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *plain, strings], schema=schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, payloads in _by_bucket(batches):
            if bucket < 0:
                yield rows_of([(-1 - bucket, _packed(*p)) for p in payloads])
                continue
            held: list[Pieces] = []
            size, limit = 0, 2 * bucket_bytes
            very = np.zeros(0, np.uint64)
            for payload in payloads:
                made = _pieces_of(payload, length, gram)
                held.append(made)
                size += len(made.data)
                if size > limit:  # fold what has come so far
                    all_, very, out = folded(held, very)
                    yield from out
                    all_ = all_.packed()
                    held, size = [all_], len(all_.data)
                    limit = max(limit, 2 * size)
            if held:
                all_, very, out = folded(held, very)
                yield from out
                yield from sorted_blocks(all_)

    def folded(held: list[Pieces], very: np.ndarray) -> tuple[Pieces, np.ndarray, list[pa.RecordBatch]]:
        """Runs that stay in the bucket, its hot grams, and what leaves it."""
        all_, gone = Pieces.joined(held).merged()
        out = [rows_of(_gone_blocks(gone, doc_buckets))] if len(gone[0]) else []
        grams, n = np.unique(all_.sample, return_counts=True)
        very = np.union1d(very, grams[n > hot])
        if len(very):
            there = np.isin(all_.sample, very)
            if there.any():
                out.append(hot_rows(all_.some(np.flatnonzero(there))))
                all_ = all_.some(np.flatnonzero(~there))
        return all_, very, out

    def sorted_blocks(all_: Pieces) -> Iterator[pa.RecordBatch]:
        order = all_.may_repeat()
        if not len(order):
            return
        sample = all_.sample[order]
        first = np.concatenate([[0], np.flatnonzero(sample[1:] != sample[:-1]) + 1])
        n = np.diff(np.append(first, len(order)))
        # blocks of whole grams
        number = np.cumsum(all_.size[order])[np.cumsum(n) - 1] // block_bytes
        for _, part in _grouped(np.arange(len(n)), number):
            low = int(first[part[0]])
            columns = places_that_go(all_.some(order[low : low + int(n[part].sum())]).packed(), length)
            if len(columns[0]):
                yield rows_of(_gone_blocks(columns, doc_buckets))

    return _dealt(blocks, buckets).mapInArrow(sort, FOUND)


def compare_hot(runs: DataFrame, length: int) -> DataFrame:
    """(key, mark, start, end) of suffixes that go, of grams in very many runs: by rows, the smallest key of each string found before rows meet."""
    string = F.substring(F.col("bytes"), F.col("w").cast("int") + 1, F.lit(length))
    rows = runs.withColumn("w", F.explode(F.sequence(F.lit(0), F.col("windows") - 1))).select("key", "mark", (F.col("start") + F.col("w")).alias("start"), string.alias("string"))
    least = rows.groupBy("string").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    return rows.join(least, "string").where("key > least").select("key", "mark", "start", (F.col("start") + length).alias("end"))


def block_places(found: DataFrame, doc_buckets: int) -> DataFrame:
    """Blocks of (key, mark, start, end) by document."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _blocks(_gone_blocks([batch.column(k).to_numpy() for k in range(4)], doc_buckets))

    return found.mapInArrow(block, BLOCKS)


# --- documents ------------------------------------------------------------------------------------------------------


def deal_docs(docs: DataFrame, doc_buckets: int, marked: bool) -> DataFrame:
    """Blocks (keys, marks, offsets, bytes, whether the key is null, other columns) of documents by key and text."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, null = _keys(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(1)), 2 * _BATCH):
                keys, marks, rows = every[i:j], _marks(data, offsets, marked), []
                for bucket, at in _grouped(np.arange(len(keys)), _bucket_of(keys ^ marks, doc_buckets)):
                    size = (offsets[1:] - offsets[:-1])[at]
                    text = data[_spread(offsets[at], size)]
                    carried = [batch.column(c).slice(i, j - i).take(pa.array(at)) for c in range(2, batch.num_columns)]
                    rows.append((bucket, _packed(keys[at], marks[at], np.concatenate([[0], np.cumsum(size)]), text.tobytes(), null[i:j][at], carried)))
                if rows:
                    yield _blocks(rows)

    return docs.mapInArrow(deal, BLOCKS)


def cut_docs(blocks: DataFrame, doc_buckets: int, key: str, texts: bool, carry: list[T.StructField]) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept], columns carried): what is left of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in _by_bucket(batches):
            sent, docs = [], []
            for p in payloads:
                (sent if len(p) == 4 else docs).append(p)
            columns = [np.concatenate([p[k] for p in sent]) if sent else np.zeros(0, np.int64) for k in range(4)]
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            while docs:
                yield cut_block(columns, *docs.pop())

    def cut_block(columns: list[np.ndarray], keys: np.ndarray, marks: np.ndarray, offsets: np.ndarray, raw: bytes, null: np.ndarray, carried: list[pa.Array]) -> pa.RecordBatch:
        data = np.frombuffer(raw, np.uint8)
        low, high = np.searchsorted(columns[0], keys, "left"), np.searchsorted(columns[0], keys, "right")
        n = high - low
        text = np.repeat(np.arange(len(keys)), n)
        at = _spread(low, n)
        fits = columns[1][at] == marks[text]
        text, at = text[fits], at[fits]
        gone = np.bincount(offsets[text] + columns[2][at], minlength=len(data) + 1) - np.bincount(offsets[text] + columns[3][at], minlength=len(data) + 1)
        keep = np.cumsum(gone[:-1]) == 0
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = keep[1:] != keep[:-1]
        edge[offsets] = True
        rows: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for t in range(len(keys)):
            a, b = int(offsets[t]), int(offsets[t + 1])
            own = keep[a:b]
            if own.all():
                spans, left = [], data[a:b].tobytes()
            else:
                cuts = np.flatnonzero(edge[a : b + 1])
                spans = [(int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if not own[x]]
                left = data[a:b][own].tobytes()
            rows["n_bytes"].append(b - a)
            rows["n_removed"].append(b - a - len(left))
            rows["n_spans"].append(len(spans))
            rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            rows["spans"].append([{"start": x, "end": y} for x, y in spans])
            if texts:
                rows["kept"].append(left.decode("utf-8", "ignore"))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        made = {c: pa.array(v, k) for (c, v), k in zip(rows.items(), kinds, strict=True) if texts or c != "kept"}
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=np.asarray(null, bool)), *made.values(), *carried], [key, *made, *(f.name for f in carry)])

    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    made = T.StructType.fromDDL(schema + (", kept string" if texts else ""))
    return _dealt(blocks, doc_buckets).mapInArrow(cut, T.StructType([*made.fields, *carry]))


def dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = 50,
    gram: int = 12,
    bucket_bytes: int = 24_000_000,
    block_bytes: int = 4_000_000,
    doc_bytes: int = 8_000_000,
    hot: int = 50_000,
    texts: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans of removed bytes[, kept: the text that is left][, columns to carry]) of each document.

    About bucket_bytes of runs are held, block_bytes of them sorted, and doc_bytes of documents cut, at once.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of a whole-number type")
    others = [docs.schema[c] for c in carry]
    whole = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text), *carry)
    docs = whole.select(key, text)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    marked = docs.groupBy(key).count().where("count > 1").limit(1).count() > 0
    per_run = (length - gram + 2) // 2  # suffixes of a run, on average
    buckets = max(partitions_for(docs.sparkSession), -(-size * (per_run + length - 1) // (per_run * bucket_bytes)))
    doc_buckets = max(1, -(-size // doc_bytes))
    dealt = deal_runs(docs, length, gram, buckets, doc_buckets, marked)
    found = written(sort_buckets(dealt, length, gram, buckets, doc_buckets, bucket_bytes, block_bytes, hot), "suffix-found")
    gone = found.where("bucket is not null").select("bucket", "payload")
    very = found.where("bucket is null")
    if very.limit(1).count():
        gone = gone.unionByName(block_places(compare_hot(very, length), doc_buckets))
    return cut_docs(gone.unionByName(deal_docs(whole, doc_buckets, marked)), doc_buckets, key, texts, others)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).drop("spans")
