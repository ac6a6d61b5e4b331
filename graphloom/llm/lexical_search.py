"""Operator 11, ranked lexical search: dense blocked matrix multiplication.

Every item is ranked against every document by exact integer scores:

1. Items. Their terms are dealt into blocks of a bounded number of bytes; each
   block's vocabulary, and nothing else, is sent to the tasks.
2. Documents. One pass over the texts for each block counts the vocabulary's
   terms in each document and writes what it finds as a narrow table: a row for
   each document with its length, its terms and how often it has them. The
   corpus statistics are sums over that table.
3. Tiles. A task takes the documents of a tile and a tile of items with the
   compact vocabulary of these items, cut to TERMS at most, lays impacts and
   weights out as dense float64 matrices and multiplies them. Impacts are under
   10**6 and weights under 2**15, so a sum over TERMS products stays under 2**53
   and is exact in any order; tiles of one item are added as 64-bit integers.
4. The best. A task keeps each item's best documents, ties by id, tile by tile;
   what the tasks kept is ranked in two steps, so no group grows with the data.

Defined results: a text without terms or a null one counts for nothing and is
never returned; an item without terms has no rows; rows repeated under one
item_id are one item with the terms of all of them; a null item_id is an item of
its own; documents repeated under one id are ranked each; a null doc_id comes
after all others of its score; an empty table gives an empty result; columns other than
key and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bytetext
from graphloom.llm.common import partitions_for, read, written

#: Bytes of a term: digits, letters and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Most terms of a tile's vocabulary: TERMS * 10**6 * 2**15 is under 2**53.
TERMS = 4096
#: Items and documents of a tile.
ITEMS, DOCUMENTS = 64, 1024
#: Bytes of terms that a block of items has at most (or one item, if it alone has more).
BLOCK = 16 << 20


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the different terms of each item; a null key is an item too."""
    small = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(small, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(found).alias("term")).distinct()


class Vocabulary:
    """The terms of a block of items: found by their hashes, and certain by their bytes."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        size = np.array([len(t) for t in raw], np.int64)
        self.text = np.frombuffer(b"".join(raw), np.uint8)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.seed = 0
        while True:
            h = bytetext.words_hash(self.text, self.begin, self.end, self.seed)
            self.order = np.argsort(h)
            self.hashes = h[self.order]
            if len(h) < 2 or (self.hashes[1:] != self.hashes[:-1]).all():
                break
            self.seed += 1

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        h = bytetext.words_hash(data, starts, ends, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        here = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[here]]
        sure = bytetext.same_bytes(data, starts[here], ends[here], self.text, self.begin[term], self.end[term])
        out[here[sure]] = term[sure]
        return out


def counted(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, terms, tf): each document with a term; terms has its vocabulary terms, in order, tf how often it has each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(1)), 2_000_000):
                data = bytetext.LOWER[data]
                starts, ends, first = bytetext.terms(data, offsets, TERM)
                n = np.diff(first)
                found = vocabulary.find(data, starts, ends)
                of = np.repeat(np.arange(j - i), n)[found >= 0]
                pair, tf = np.unique((of << 32) | found[found >= 0], return_counts=True)
                at = np.searchsorted(pair >> 32, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (pair & 0xFFFFFFFF, tf)]
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *lists], ["key", "n", "terms", "tf"])
                yield made.filter(pa.array(n > 0))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"key {kind}, n long, terms array<int>, tf array<int>")


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m), where m is 50 + (50 * n * n_docs) div n_terms."""
    if len(n) and 50 * n_docs * int(n.max()) >= 1 << 63:
        m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _best(score: np.ndarray, row: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k best by score, then by rank."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)  # with all that tie with the last
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((rank[row[keep]], -score[keep]))[:k]]


def _block_top(held: DataFrame, of_item: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(slot, item, key, score): what each task keeps of each item; of_item has each item's terms by number."""
    tiles = []
    size = len(of_item)
    for a in range(0, size, ITEMS):
        some = of_item[a : a + ITEMS]
        used = np.unique(np.concatenate(some))
        for b in range(0, len(used), TERMS):
            part = used[b : b + TERMS]
            tiles.append((a, part, [np.searchsorted(part, t[(t >= part[0]) & (t <= part[-1])]) for t in some]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple] | None] = [None] * size
        place = np.full(len(weight) + 1, -1, np.int64)
        for batch in batches:
            for since in range(0, batch.num_rows, DOCUMENTS):
                tile = batch.slice(since, DOCUMENTS)
                keys = tile.column(0)
                terms, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (tile.column(2), tile.column(3)))
                length = tile.column(1).to_numpy(zero_copy_only=False)
                each = np.diff(tile.column(2).offsets.to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(tile.num_rows), each)
                worth = impact(tf, length[row], n_docs, n_terms)
                score = np.zeros((tile.num_rows, size), np.int64)
                for a, part, some in tiles:
                    place[part] = np.arange(len(part))
                    column = place[terms]
                    here = np.flatnonzero(column >= 0)
                    left = np.zeros((tile.num_rows, len(part)))
                    left[row[here], column[here]] = worth[here]
                    right = np.zeros((len(part), len(some)))
                    for i, own in enumerate(some):
                        right[own, i] = weight[part[own]]
                    score[:, a : a + len(some)] += (left @ right).astype(np.int64)
                    place[part] = -1
                order = np.lexsort((np.array([x if x is not None else 0 for x in keys.to_pylist()]), keys.is_null().to_numpy(zero_copy_only=False)))
                by_key = np.empty(len(order), np.int64)
                by_key[order] = np.arange(len(order))
                for i in range(size):
                    own = score[:, i]
                    floor = 1 if best[i] is None or len(best[i]) < k else best[i][-1][0]
                    hit = np.flatnonzero(own >= floor)
                    if not len(hit):
                        continue
                    hit = hit[_best(own[hit], hit, by_key, k)]
                    mine = [(s, x) for s, x in zip(own[hit].tolist(), keys.take(pa.array(hit)).to_pylist(), strict=True)]
                    best[i] = sorted([*(best[i] or []), *mine], key=lambda p: (-p[0], p[1] is None, 0 if p[1] is None else p[1]))[:k]
        slot = TaskContext.get().partitionId()
        for i in range(size):
            if best[i]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot] * len(best[i]), pa.int32()), pa.array([i] * len(best[i]), pa.int32()), pa.array([x for _, x in best[i]]).cast(kind), pa.array([s for s, _ in best[i]], pa.int64())],
                    ["slot", "item", "key", "score"],
                )

    sql = held.schema["key"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[sql]
    return held.mapInArrow(rank, f"slot int, item int, key {sql}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_key, rank, doc_key, score): the k best documents of each item with a score above 0, equal scores by ascending doc_key.

    doc_key is an integer or a string. Blocks of items are searched one after the other.
    """
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_key, text), "search-items")
    size = pairs.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = 1
    if size > block:  # a share of the items for each block, smaller until none has too much
        per = written(pairs.groupBy("item").agg(F.sum(F.octet_length("term")).alias("size"), F.count(F.lit(1)).alias("n")), "search-sizes")
        while True:
            blocks = max(blocks * 2, -(-2 * size // block))
            most = per.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks))).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).agg(F.max(F.when((F.col("n") > 1), F.col("size")))).first()[0]
            if most is None or most <= block:
                break
    kinds = pairs.schema["item"].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString()
    found = []
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else pairs
        rows = own.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()  # a block's terms: bounded
        if not rows:
            continue
        names = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(names)}
        of_item = [np.sort(np.array([number[t] for t in r.terms], np.int64)) for r in rows]
        held = written(counted(docs, Vocabulary(names), doc_key, text), f"search-terms-{b}")
        n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(names), np.int64)
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each term of the block
            df[r.term] = r.n
        weight = np.array([math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * x + 1.0))) for x in df.tolist()], np.float64)
        kept = _block_top(held, of_item, weight, n_docs, n_terms, k)
        order = [F.col("score").desc(), F.col("key").isNull(), F.col("key")]
        few = kept.withColumn("slot", F.pmod("slot", F.lit(partitions_for(spark))))
        few = few.withColumn("_at", F.row_number().over(Window.partitionBy("item", "slot").orderBy(*order))).where(F.col("_at") <= k)
        top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        item = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item int, name {kinds[0]}")
        found.append(top.join(F.broadcast(item), "item").select(F.col("name").alias(item_key), "rank", F.col("key").alias(doc_key), "score"))
    if not found:
        return spark.createDataFrame([], f"`{item_key}` {kinds[0]}, rank int, `{doc_key}` {kinds[1]}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
