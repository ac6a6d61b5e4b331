"""Call chains: a breadth-first walk over callers and callees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import find_symbols

MAX_DEPTH = 5


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, in that which the driver and all executors share: spark.checkpoint.dir, or for local runs without one a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage, written to the folder that all executors share."""
    spark = df.sparkSession
    path = new_folder(spark, "trace")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _steps(calls: DataFrame, symbols: DataFrame, level: DataFrame, way: str) -> DataFrame:
    """(id, k) with k the first (seq, way, via) by which a symbol is reached from a level (id, name, container, via, seq).

    Each name, or name and container, carries its first predecessor before it meets calls or symbols: rows don't multiply.
    """
    first = F.min(F.struct("seq", F.lit(way).alias("way"), "via")).alias("k")
    free, bound = calls.where("receiver IS NULL"), calls.where("receiver IS NOT NULL")
    if way == "inbound":
        by_name = level.groupBy(F.col("name").alias("callee")).agg(first)
        by_pair = level.where("container IS NOT NULL").groupBy(F.col("name").alias("callee"), F.col("container").alias("receiver")).agg(first)
        plain = level.where("container IS NULL").groupBy(F.col("name").alias("callee")).agg(first)
        met = free.join(by_name, "callee").select("symbol_id", "k").unionByName(bound.join(by_pair, ["callee", "receiver"]).select("symbol_id", "k")).unionByName(bound.join(plain, "callee").select("symbol_id", "k"))
        return met.groupBy(F.col("symbol_id").alias("id")).agg(F.min("k").alias("k"))
    made = calls.join(level.select(F.col("id").alias("symbol_id"), "seq", "via"), "symbol_id").groupBy("callee", "receiver").agg(first)
    at = symbols.select("id", F.col("name").alias("callee"), F.col("container").alias("receiver"))
    met = made.where("receiver IS NULL").select("callee", "k").join(at, "callee").select("id", "k").unionByName(made.where("receiver IS NOT NULL").join(at, ["callee", "receiver"]).select("id", "k"))
    return met.groupBy("id").agg(F.min("k").alias("k"))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, gapless from 0 in an order: rows are sorted by ranges, each range counts on from those before it.

    Within a range its number, the partition of a table that is written, is fixed; one row for each range moves.
    """
    spark = rows.sparkSession
    columns = rows.columns
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    dealt = rows.select("*", *keys).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), *[f"_o{i}" for i in range(len(order))])
    held = _cut(dealt.withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range").orderBy(*[f"_o{i}" for i in range(len(order))])
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()  # as many as there are shuffle partitions
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r[0], before))
        before += r[1]
    first = spark.createDataFrame(starts, "_range int, _before long")
    return held.withColumn("_n", F.row_number().over(here)).join(F.broadcast(first), "_range").select(*columns, (F.col("_n") - 1 + F.col("_before")).alias("place"))


def trace(calls: DataFrame, symbol_rows: DataFrame, query: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """(id, qualified, depth, direction, via): the symbols reached from the first one that the query finds.

    Depth is kept within 1 to 5. After the first step a branch keeps its direction. A symbol is reached once, by the
    first of its level in the order of the walk: the predecessor's place, callers before callees, path, line, id.
    Each level meets the calls by joins and leaves out what was reached before.
    """
    depth = min(max(depth, 1), MAX_DEPTH)
    at = symbol_rows.select("id", "qualified", "name", "container", "path", "start_line")
    origin = find_symbols(symbol_rows, query).orderBy("path", "start_line", "id").limit(1)
    level = _cut(origin.select("id", "name", "container", F.col("qualified").alias("via"), F.lit(direction).alias("direction"), F.lit(0).cast("long").alias("seq")))
    reached = level.select("id")
    found: DataFrame | None = None
    for step in range(1, depth + 1):
        ways = [_steps(calls, symbol_rows, level.where(F.col("direction").isin("both", w)), w) for w in ("inbound", "outbound") if direction in ("both", w)]
        met = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]).groupBy("id").agg(F.min("k").alias("k"))
        new = met.join(reached, "id", "left_anti").join(at, "id")
        new = _placed(new, ["k.seq", "k.way", "path", "start_line", "id"])
        new = _cut(new.select("id", "name", "container", "qualified", F.lit(step).cast("long").alias("depth"), F.col("k.way").alias("direction"), F.col("k.via").alias("via"), F.col("place").alias("seq")))
        found = new if found is None else found.unionByName(new)
        level = new.select("id", "name", "container", F.col("qualified").alias("via"), "direction", "seq")
        reached = reached.unionByName(new.select("id"))
    return found.select("id", "qualified", "depth", "direction", "via")
