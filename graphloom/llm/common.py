"""Small helpers that the corpus operators share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than these (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_space(text: Column) -> Column:
    """text with every white-space character as a space."""
    for ch in SPACES[1:]:
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """The words of a text, in order (null text: none)."""
    return F.array_remove(F.split(one_space(F.coalesce(text, F.lit(""))), " ", -1), "")


def solid_length(text: Column) -> Column:
    """Code points of a text that are not white space."""
    return F.length(F.replace(one_space(text), F.lit(" "), F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session, or for local runs a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class _Made(threading.local):
    def __init__(self) -> None:
        self.paths: list[str] = []


#: Folders that written() has made in this thread, in order, for those who know when a step is over.
made = _Made()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    made.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(spark: SparkSession, factor: int = 1) -> int:
    """As many partitions as the session shuffles into, times factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * factor


#: A key held by more than this share of all rows is hot; there are fewer than 1 / HOT_SHARE of them, whatever the data.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with small, which has one row for each key and in ``count`` how many of ``total`` rows hold it.

    Keys that hold more than HOT_SHARE of the rows (less than 1 / HOT_SHARE of them) are joined by broadcast, so that
    their rows stay where they are; the others are joined by a shuffle in which no key is large.
    """
    hot = small.where(F.col(count) > HOT_SHARE * total).drop(count)
    cold = small.where(F.col(count) <= HOT_SHARE * total).drop(count)
    keys = F.broadcast(hot.select(key))
    there = rows.join(F.broadcast(hot), key)
    return there.unionByName(rows.join(keys, key, "left_anti").join(cold, key, how), allowMissingColumns=True)


def numbered(rows: DataFrame, group: str, name: str, label: str) -> DataFrame:
    """rows with a number, gapless from 0 within each value of an integer column: two passes, no shuffle of the rows.

    Each task numbers its own rows; then what the tasks before it have of a group is added. Tasks times groups totals move.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def count(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            value = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            at = np.zeros(len(value), np.int64)
            for v in np.unique(value):
                here = np.flatnonzero(value == v)
                at[here] = np.arange(len(here)) + seen.get(v, 0)
                seen[v] = seen.get(v, 0) + len(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part), pa.int32()), pa.array(at)], [*batch.schema.names, "_part", "_at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    held = written(rows.mapInArrow(count, schema), label)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("_part", group).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return held.join(F.broadcast(totals), ["_part", group]).withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def bitmap(df: DataFrame, column: str, bits: int):
    """The values of a long column as a bitmap of 2 ** bits bits, at least 2 ** 15: its size is fixed, whatever df has."""
    import numpy as np

    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = df.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for at, held in rows.collect():
        out[(at - 1) * 4096 : at * 4096] = np.frombuffer(held, np.uint8)
    return out


def bits_set(marks, values, bits: int):
    """Which 64-bit values a bitmap of 2 ** bits bits has; it may have more than were put in."""
    import numpy as np

    slot = values & np.uint64((1 << bits) - 1)
    return (marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def release() -> None:
    """Gives memory that is free within this process back to the system: workers live on after their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
