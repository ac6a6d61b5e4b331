"""Operator 5, sharding: Karmarkar-Karp differencing over groups of equal texts.

A group (all documents with one text) is indivisible. Groups are dealt to tasks
by their hash; each task differences its groups: the two partial partitions with
the largest spread are combined in opposite order, again and again, until one
remains. The tasks' partitions, a sum for each shard, are combined by the same
rule: in tasks of a bounded number each, level by level, until one is left.

Defined results: a null text has size 1 and is of the same group as an empty
one; a null doc_id is carried along; repeated rows are of the same group; an
empty table gives an empty result; ties in spread are settled by the order of
the groups' hashes; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, numbered, read, written


def differenced(items: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """(sums, places): each item is a list of sums, largest first; its i-th sum goes to shard places[item][i].

    The sums returned are in the order of the shards, largest first.
    """
    n = len(items)
    heap = [(-(x[0] - x[-1]), i) for i, x in enumerate(items)]
    heapq.heapify(heap)
    sums = {i: x for i, x in enumerate(items)}
    joins: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(shards), key=both.__getitem__, reverse=True)
        to = [0] * shards
        for new, old in enumerate(order):
            to[old] = new
        c = n + len(joins)
        joins.append((a, b, to))
        sums[c] = both = [both[i] for i in order]
        heapq.heappush(heap, (-(both[0] - both[-1]), c))
    root = heap[0][1]
    places: dict[int, list[int]] = {root: list(range(shards))}
    for c in range(n + len(joins) - 1, n - 1, -1):
        at = places.pop(c)
        a, b, to = joins[c - n]
        places[a] = [at[to[i]] for i in range(shards)]
        places[b] = [at[to[shards - 1 - i]] for i in range(shards)]
    return sums[root], [places[i] for i in range(n)]


def _combine_level(parts: DataFrame, shards: int, tasks: int) -> DataFrame:
    """(part, upper, sums of upper, places) for (part, sums): each task makes one partition of its own."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["part"], r["sums"]) for b in batches for r in b.to_pylist())
        if rows:
            sums, places = differenced([s for _, s in rows], shards)
            upper = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.int32()), pa.array([upper] * len(rows), pa.int32()), pa.array([sums] * len(rows), pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                ["part", "upper", "sums", "places"],
            )

    return parts.repartition(tasks, "part").mapInArrow(combine, "part int, upper int, sums array<long>, places array<int>")


def shard_groups(groups: DataFrame, shards: int = 16, per_task: int = 50_000, per_level: int = 1_000) -> DataFrame:
    """(digest, shard) for (digest, bytes): near-equal bytes in each shard."""
    tasks = max(1, -(-groups.count() // per_task))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((n, d) for b in batches for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), reverse=True)
        if rows:
            sums, places = differenced([[n] + [0] * (shards - 1) for n, _ in rows], shards)
            part = TaskContext.get().partitionId()
            for i in range(0, len(rows), 10_000):
                some = rows[i : i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for _, d in some], pa.binary()), pa.array([part] * len(some), pa.int32()), pa.array([p[0] for p in places[i : i + 10_000]], pa.int32()), pa.array([sums if i + k == 0 else None for k in range(len(some))], pa.list_(pa.int64()))],
                    ["digest", "part", "slot", "sums"],
                )

    dealt = groups.select("digest", "bytes").repartition(tasks, "digest").mapInArrow(first, "digest binary, part int, slot int, sums array<long>")
    dealt = written(dealt, "shard-groups")
    parts = dealt.where("sums is not null").select("part", "sums")
    place = parts.select("part", F.col("part").alias("upper"), F.array(*[F.lit(i) for i in range(shards)]).alias("places"))
    while True:
        tasks = max(1, -(-tasks // per_level))
        level = written(_combine_level(parts, shards, tasks), "shard-level")
        up = level.select(F.col("part").alias("upper"), F.col("upper").alias("next"), F.col("places").alias("onto"))
        place = place.join(up, "upper").select("part", F.col("next").alias("upper"), F.transform("places", lambda i: F.get(F.col("onto"), i)).alias("places"))
        if tasks == 1:
            break
        parts = level.groupBy(F.col("upper").alias("part")).agg(F.any_value("sums").alias("sums"))
    return dealt.join(place.select("part", "places"), "part").select("digest", F.get(F.col("places"), F.col("slot")).alias("shard"))


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): equal texts share a shard, bytes are near equal, slots are gapless."""
    value = F.coalesce(F.col(text), F.lit(""))
    raw = value.cast("binary")
    narrow = docs.select(key, (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"))
    narrow = written(narrow, "shard-docs")
    groups = written(narrow.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-sizes")
    total = narrow.count()
    placed = shard_groups(groups, shards).join(groups.select("digest", "rows"), "digest")
    return numbered(join_hot(narrow, placed, "digest", "rows", total).drop("digest"), "shard", "slot", "shard-slots")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
