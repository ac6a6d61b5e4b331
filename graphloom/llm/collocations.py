"""Operator 13, phrase collocation mining: weighted acyclic automata.

Phrases are counted exactly, in three passes over the texts:

1. Words. Each task counts its words; sums by word give the dictionary and the
   words that are frequent enough to be part of a phrase. A word's label is a
   64-bit hash of its language and bytes; the sums show whether two words share
   a label, and then other labels are taken.
2. Pairs, and 3. pairs to phrases of LONGEST words. A task gathers a shard of
   SHARD words at most, sorts its n-grams and builds count transducers from them
   in order: a transition carries a label and how often the n-gram that ends
   with it stands in the shard; states whose transitions are alike are one.
   They are cut by ranges of prefixes (the first two labels), so the part of one
   range moves as one row, and each range's parts are united and their weights
   summed, a bounded number at a time. Words of a large share of all have their
   range cut by the second label.

A longer n-gram is followed only where its words (second pass) or pairs (third)
are frequent. What is frequent is sent to the tasks as a bitmap of bounded size:
a wrong mark adds work, and a count is of all occurrences in any case.

Parts are looked up by composing phrases with the sums: first parts stand on a
phrase's own path and come with it, last parts are paths of other ranges and
meet them by a join of labels, whose hot keys Spark splits.

Defined results: a null or empty text has no words; a null language is UND;
repeated rows count each; ties are in order of the phrase's bytes; an empty
table gives an empty result; columns other than text and lang are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bytetext
from graphloom.llm.common import bitmap, bits_set, partitions_for, read, release, written

#: Words of a phrase at most.
LONGEST = 4
#: Words that a task counts at once.
SHARD = 700_000
#: Bits of a bitmap for each word or pair that it marks, and how large it can be: 2 ** MOST_BITS bits are 128 MB.
BITS_EACH, MOST_BITS = 32, 30
#: Transitions that are united at once.
UNITED = 300_000
UND = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[10:14] = True
_SOLID = ~_BREAK
_SOLID[[32, 9]] = False


class Automaton:
    """An acyclic automaton of sorted n-grams whose transitions carry counts.

    ``names`` has the labels, in order. Level k has the k-th words' transitions, state by state: which label, its weight,
    and the state of level k + 1 it leads to; ``first`` says where each state's transitions begin.
    """

    def __init__(self, names: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.names, self.levels = names, levels

    @classmethod
    def built(cls, names: np.ndarray, parents: list[np.ndarray], labels: list[np.ndarray], weights: list[np.ndarray]) -> Automaton:
        """From the sorted prefixes of each length: the place of each one's own prefix, its last label and its count."""
        levels: list[tuple] = [()] * len(labels)
        state = np.zeros(len(labels[-1]), np.int64)  # of the state that each prefix of this length leads to; nothing follows the longest
        for k in range(len(labels) - 1, -1, -1):
            above = len(labels[k - 1]) if k else 1
            first = np.searchsorted(parents[k], np.arange(above + 1))
            # states are alike if they have as many transitions with the same labels, weights and states
            each = bytetext.mixed(bytetext.mixed(labels[k].astype(np.uint64) ^ bytetext.mixed(weights[k].astype(np.uint64))) + bytetext.mixed(state.astype(np.uint64) + np.uint64(7)))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
            alike = sums[first[1:]] - sums[first[:-1]]
            _, one, which = np.unique(alike, return_index=True, return_inverse=True)
            size = np.diff(first)
            same = size == size[one[which]]
            at = np.arange(len(labels[k])) - np.repeat(first[:-1], size)
            twin = np.minimum(np.repeat(first[one[which]], size) + at, max(0, len(labels[k]) - 1))
            differs = (labels[k] != labels[k][twin]) | (weights[k] != weights[k][twin]) | (state != state[twin])
            owner = np.repeat(np.arange(above), size)
            same[owner[differs]] = False
            keep = ~same
            keep[one] = True
            number = np.cumsum(keep) - 1
            into = np.where(same, number[one[which]], number)
            kept = keep[owner]
            levels[k] = (np.concatenate([[0], np.cumsum(size[keep])]), labels[k][kept], weights[k][kept], state[kept])
            state = into
        return cls(names, levels)

    def paths(self) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """(parents, labels, weights) as for built()."""
        parents, labels, weights = [], [], []
        state = np.zeros(1, np.int64)
        for first, label, weight, target in self.levels:
            size = first[state + 1] - first[state]
            upto = np.cumsum(size)
            at = np.repeat(first[state] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
            parents.append(np.repeat(np.arange(len(state)), size))
            labels.append(label[at])
            weights.append(weight[at])
            state = target[at]
        return parents, labels, weights

    def size(self) -> int:
        return sum(len(level[1]) for level in self.levels)

    def to_bytes(self) -> bytes:
        """The arrays in as few bytes a number as each needs, after a header of their widths and lengths."""
        arrays = [self.names, *(x for level in self.levels for x in level)]
        head = [len(self.levels)]
        body = []
        for x in arrays:
            most = int(x.max(initial=0))
            width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
            head += [width, len(x)]
            body.append(x.astype(f"<u{width}").tobytes())
        return np.array(head, "<u8").tobytes() + b"".join(body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Automaton:
        depth = int(np.frombuffer(raw, "<u8", 1)[0])
        head = np.frombuffer(raw, "<u8", 2 * (1 + 4 * depth), 8).tolist()
        at, arrays = 8 * (1 + len(head)), []
        for width, many in zip(head[::2], head[1::2], strict=True):
            arrays.append(np.frombuffer(raw, f"<u{width}", many, at).astype(np.int64 if arrays else np.uint64))
            at += width * many
        return cls(arrays[0], [tuple(arrays[1 + 4 * k : 5 + 4 * k]) for k in range(depth)])


def union(parts: list[Automaton]) -> Automaton:
    """The automaton of all n-grams of the parts, with their weights summed."""
    if len(parts) == 1:
        return parts[0]
    names = np.unique(np.concatenate([p.names for p in parts]))
    depth = len(parts[0].levels)
    opened = [p.paths() for p in parts]
    state = [np.zeros(1, np.int64) for _ in parts]
    out: tuple[list, list, list] = ([], [], [])
    for k in range(depth):
        code = [(s[o[0][k]] << 32) | np.searchsorted(names, p.names)[o[1][k]] for p, o, s in zip(parts, opened, state, strict=True)]
        found, which = np.unique(np.concatenate(code), return_inverse=True)
        weight = np.zeros(len(found), np.int64)
        np.add.at(weight, which, np.concatenate([o[2][k] for o in opened]))
        ends = np.cumsum([0, *map(len, code)])
        state = [which[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for into, x in zip(out, (found >> 32, found & 0xFFFFFFFF, weight), strict=True):
            into.append(x)
    return Automaton.built(names, *out)


class _Shards:
    """Words of batches of (text, lang): labels, whether the next word goes on in the same piece, and the language of each."""

    def __init__(self, seed: int) -> None:
        self.seed, self.languages, self.salts = seed, {}, []

    def read(self, batch: pa.RecordBatch):
        names = batch.column(1).to_pylist()
        for x in names:
            if x not in self.languages:
                self.languages[x] = len(self.languages)
                self.salts.append(xxhash.xxh3_64_intdigest(x.encode(), self.seed))
        code = np.array([self.languages[x] for x in names], np.int32)
        salts = np.array(self.salts, np.uint64)
        for i, j, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(0)), 2_000_000):
            data = bytetext.LOWER[data]
            starts, ends, first = bytetext.terms(data, offsets, _SOLID)
            lang = np.repeat(code[i:j], np.diff(first))
            label = bytetext.mixed(bytetext.words_hash(data, starts, ends, self.seed) ^ salts[lang])
            part = np.cumsum(_BREAK[data])
            on = np.zeros(len(starts), bool)
            on[:-1] = part[starts[1:]] == part[starts[:-1]]
            on[first[1:-1][(first[1:-1] > 0)] - 1] = False
            yield data, starts, ends, label, on, lang

    def names(self) -> list[str]:
        return list(self.languages)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def words(docs: DataFrame, seed: int, shard: int) -> DataFrame:
    """(lang, label, word, f) of each shard's different words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(seed)
        known, found, seen = np.zeros(0, np.uint64), [], []
        held = 0

        def flush():
            nonlocal known, found, seen, held
            if held:
                new = pa.concat_arrays([x[1] for x in found])
                label = np.concatenate([x[0] for x in found])
                lang = np.concatenate([x[2] for x in found])
                order = np.argsort(label)
                all_, which = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
                f = np.zeros(len(all_), np.int64)
                np.add.at(f, which, np.concatenate([x[1] for x in seen]))
                names = pa.array(shards.names()).take(pa.array(lang[order]))
                for a in range(0, len(order), 100_000):
                    some = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([names[some], pa.array(label[order][some].view(np.int64)), new.take(pa.array(order[some])), pa.array(f[some])], ["lang", "label", "word", "f"])
            known, found, seen, held = np.zeros(0, np.uint64), [], [], 0

        for batch in batches:
            for data, starts, ends, label, _, lang in shards.read(batch):
                if not len(label):
                    continue
                one, at, n = np.unique(label, return_index=True, return_counts=True)
                new = ~np.isin(one, known, assume_unique=True)
                found.append((one[new], _strings(data, starts[at[new]], ends[at[new]]), lang[at[new]]))
                seen.append((one, n))
                known = np.concatenate([known, one[new]])
                held += len(label)
                if held >= shard:
                    yield from flush()
        yield from flush()
        release()

    return docs.mapInArrow(count, "lang string, label long, word string, f long")


def range_of(a: np.ndarray, b: np.ndarray, bits: int, hot: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of prefixes that holds each pair of labels; those of hot first labels are cut by the second."""
    out = (a >> np.uint64(64 - bits)).astype(np.int64) << 16
    if len(hot):
        at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
        out += np.where(hot[at] == a, ((b >> np.uint64(32)) * cuts[at].astype(np.uint64)) >> np.uint64(32), np.uint64(0)).astype(np.int64)
    return out


def transducers(docs: DataFrame, seed: int, shard: int, longest: int, marks, bits: int, hot: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """(lang, range, automaton) of each shard's n-grams of up to ``longest`` words; marks(a, b) says which pairs to follow."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(seed)
        held: list[tuple] = []

        def flush():
            label, on, lang = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            names, which = np.unique(label, return_inverse=True)
            lang_of = np.zeros(len(names), np.int64)
            lang_of[which] = lang
            pair = on.copy()
            pair[:-1] &= marks(label[:-1], label[1:])
            pair[-1] = False
            at = np.flatnonzero(pair)
            code, state, n = np.unique((which[at] << 32) | which[at + 1], return_inverse=True, return_counts=True)
            first, second = code >> 32, code & 0xFFFFFFFF
            parents, labels, weights = [], [second], [n]
            for k in range(3, longest + 1):
                more = np.flatnonzero(pair[at + k - 2]) if len(at) else np.zeros(0, np.int64)
                at, state = at[more], state[more]
                code, state, n = np.unique((state << 32) | which[at + k - 1], return_inverse=True, return_counts=True)
                parents.append(code >> 32)
                labels.append(code & 0xFFFFFFFF)
                weights.append(n)
            own = range_of(names[first], names[second], bits, hot, cuts)
            key = (lang_of[first] << 40) | own
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
            rows, held_bytes = [], 0
            for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(order)], strict=False):
                rows.append((int(key[order[a]]), cut(names, first, parents, labels, weights, order[a:b])))
                held_bytes += len(rows[-1][1])
                if held_bytes > 4_000_000:
                    yield batch_of(rows)
                    rows, held_bytes = [], 0
            if rows:
                yield batch_of(rows)

        def cut(names, first, parents, labels, weights, pairs):
            """The automaton of the n-grams that begin with these pairs."""
            heads, above = np.unique(first[pairs], return_inverse=True)
            tree = ([np.zeros(len(heads), np.int64), above], [heads, labels[0][pairs]], [np.zeros(len(heads), np.int64), weights[0][pairs]])
            kept = pairs
            for k in range(1, len(labels)):
                a, b = np.searchsorted(parents[k - 1], kept), np.searchsorted(parents[k - 1], kept + 1)
                size = b - a
                upto = np.cumsum(size)
                own = np.repeat(a - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
                for into, x in zip(tree, (np.repeat(np.arange(len(kept)), size), labels[k][own], weights[k][own]), strict=True):
                    into.append(x)
                kept = own
            used = np.unique(np.concatenate(tree[1]))
            return Automaton.built(names[used], tree[0], [np.searchsorted(used, x) for x in tree[1]], tree[2]).to_bytes()

        def batch_of(rows):
            known = shards.names()
            return pa.RecordBatch.from_arrays(
                [pa.array([known[k >> 40] for k, _ in rows]), pa.array([k & ((1 << 40) - 1) for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["lang", "range", "automaton"]
            )

        size = 0
        for batch in batches:
            for _, _, _, label, on, lang in shards.read(batch):
                if len(label):
                    held.append((label, on, lang))
                    size += len(label)
                if size >= shard:
                    yield from flush()
                    size = 0
                    release()
        if size:
            yield from flush()
        release()

    return docs.mapInArrow(build, "lang string, range long, automaton binary")


def summed(parts: DataFrame, longest: int, least: int, partitions: int) -> DataFrame:
    """(lang, size, a, b, c, d, f, ab, abc): the n-grams of two words or more found ``least`` times or more, with the counts along their paths.

    A range's parts come one after the other and are united as they come, so a task holds what is different in a range and
    UNITED transitions besides. c and d are 0 where an n-gram has no such word.
    """

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def rows_of(key, all_: Automaton):
            parents, labels, weights = all_.paths()
            path = [all_.names[labels[0]]]
            names, counts = [path], [[]]
            for k in range(1, len(labels)):
                up = parents[k]
                names.append([*[x[up] for x in names[-1]], all_.names[labels[k]]])
                counts.append([*[x[up] for x in counts[-1]], weights[k]])
            for k in range(1, len(labels)):
                keep = np.flatnonzero(weights[k] >= least)
                n = len(keep)
                zero = np.zeros(n, np.int64)
                words_ = [x[keep].view(np.int64) for x in names[k]] + [zero] * (LONGEST - k - 1)
                along = [x[keep] for x in counts[k][:-1]] + [zero] * (LONGEST - 1 - k)
                for a in range(0, n, 100_000):
                    b = min(n, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * (b - a), pa.string()), pa.array(np.full(b - a, k + 1), pa.int32()), *[pa.array(x[a:b]) for x in words_], pa.array(weights[k][keep][a:b]), *[pa.array(x[a:b]) for x in along[:2]]],
                        ["lang", "size", "a", "b", "c", "d", "f", "ab", "abc"],
                    )

        for batch in batches:
            for lang, range_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (lang, range_) != now:
                    if held:
                        yield from rows_of(now, union(held))
                    now, held, size = (lang, range_), [], 0
                held.append(Automaton.from_bytes(raw.as_py()))
                size += held[-1].size()
                if size > UNITED and len(held) > 1:
                    held = [union(held)]
                    size = 0
        if held:
            yield from rows_of(now, union(held))
        release()

    dealt = parts.repartition(partitions, "lang", "range").sortWithinPartitions("lang", "range")
    return dealt.mapInArrow(unite, "lang string, size int, a long, b long, c long, d long, f long, ab long, abc long")


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bytetext.mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _bits_for(n: int) -> int:
    return min(MOST_BITS, max(20, (BITS_EACH * n).bit_length()))


def mine(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = LONGEST, text: str = "text", lang: str = "lang", shard: int = SHARD, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be from 2 to {LONGEST}")
    spark = docs.sparkSession
    parts = partitions_for(spark)
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UND)).alias("lang"))
    seed = 0
    while True:  # until each label of a frequent word is of one word
        each = words(docs, seed, shard).repartition(parts, "label").groupBy("label", "lang", "word").agg(F.sum("f").alias("f"))
        dictionary = written(each, "phrases-words")
        shared = dictionary.groupBy("label").agg(F.count(F.lit(1)).alias("words"), F.sum("f").alias("f")).where((F.col("words") > 1) & (F.col("f") >= least))
        if not shared.limit(1).count():
            break
        seed += 1
    totals = dictionary.groupBy("lang").agg(F.sum("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    frequent = dictionary.where(F.col("f") >= least)
    # ranges: some for each task, more of them the more words there are
    cut_bits = min(16, max(parts, total // 4_000_000, 2).bit_length())
    share = max(1, total >> cut_bits)
    hot = frequent.where(F.col("f") > share).select("label", "f").collect()  # fewer than 2 ** cut_bits
    hot = sorted((r.label % (1 << 64), min(1 << 15, -(-r.f // share))) for r in hot)
    labels, cuts = np.array([x for x, _ in hot], np.uint64), np.array([x for _, x in hot], np.int64)

    n = bits or _bits_for(frequent.count())
    marked = spark.sparkContext.broadcast(bitmap(frequent.select("label"), "label", n))
    both = lambda a, b: bits_set(marked.value, a, n) & bits_set(marked.value, b, n)
    pairs = summed(transducers(docs, seed, shard, 2, both, cut_bits, labels, cuts), 2, least, parts)
    if longest > 2:

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(_pair_key(a, b).view(np.int64))], ["key"])

        found = written(pairs.select("a", "b").mapInArrow(keyed, "key long"), "phrases-pairs")
        marked.destroy()
        m = bits or _bits_for(found.count())
        linked = spark.sparkContext.broadcast(bitmap(found, "key", m))
        follow = lambda a, b: bits_set(linked.value, _pair_key(a, b), m)
        counts = written(summed(transducers(docs, seed, shard, longest, follow, cut_bits, labels, cuts), longest, least, parts), "phrases-counts")
        linked.destroy()
    else:
        counts = written(pairs, "phrases-counts")
        marked.destroy()
    return _ranked(counts, frequent, totals, least, top)


def _ranked(counts: DataFrame, frequent: DataFrame, totals: DataFrame, least: int, top: int) -> DataFrame:
    one = frequent.select("label", "f")
    of = lambda name, f: one.select(F.col("label").alias(name), F.col("f").alias(f))
    two, three, four = (counts.where(F.col("size") == k) for k in (2, 3, 4))
    pair = lambda x, y, f: two.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f))
    trio = lambda x, y, z, f: three.select(F.col("a").alias(x), F.col("b").alias(y), F.col("c").alias(z), F.col("f").alias(f))
    cut = lambda k, left, right: F.struct(
        F.expr(f"cast(f as decimal(38,0)) * 2000000 div (cast({left} as decimal(38,0)) + {right})").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")
    )
    got = [
        two.join(of("a", "fa"), "a").join(of("b", "fb"), "b").withColumn("cut", cut(1, "fa", "fb")),
        three.join(pair("b", "c", "fbc"), ["b", "c"]).join(of("a", "fa"), "a").join(of("c", "fc"), "c").withColumn("cut", F.least(cut(1, "fa", "fbc"), cut(2, "ab", "fc"))),
        four.join(trio("b", "c", "d", "fbcd"), ["b", "c", "d"]).join(pair("c", "d", "fcd"), ["c", "d"]).join(of("a", "fa"), "a").join(of("d", "fd"), "d")
        .withColumn("cut", F.least(cut(1, "fa", "fbcd"), cut(2, "ab", "fcd"), cut(3, "abc", "fd"))),
    ]
    columns = ["lang", "size", "a", "b", "c", "d", "f", "cut"]
    scored = got[0].select(columns).unionByName(got[1].select(columns)).unionByName(got[2].select(columns))
    # the most frequent longer phrase that each phrase stands in
    zero = F.lit(0).cast("long")
    inner = counts.where("size > 2").select("f", F.explode(
        F.when(F.col("size") == 3, F.array(F.struct("a", "b", zero.alias("c")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), zero.alias("c"))))
        .otherwise(F.array(
            F.struct("a", "b", zero.alias("c")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), zero.alias("c")), F.struct(F.col("c").alias("a"), F.col("d").alias("b"), zero.alias("c")),
            F.struct("a", "b", "c"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c")),
        ))).alias("x"))
    held = inner.groupBy("x.a", "x.b", "x.c").agg(F.max("f").alias("most"), F.lit(0).cast("long").alias("d"))
    kept = scored.join(held, ["a", "b", "c", "d"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 80 * F.col("f")))
    # words are spelled out only where they can be among the first; all that tie with the last are there
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("f").desc())
    few = written(kept.withColumn("_rank", F.rank().over(best)).where(F.col("_rank") <= top), "phrases-first")
    spelled = few
    for i, c in enumerate("abcd"):
        word = frequent.select(F.col("label").alias(c), F.col("word").alias(f"w{i}"))
        spelled = spelled.join(word, c, "inner" if i < 2 else "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", "w0", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("f").desc(), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))
