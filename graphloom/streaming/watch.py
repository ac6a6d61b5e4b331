"""Watching a folder of listings: each micro-batch is classified against the snapshot and folded into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.operators import index

LISTING = "path string, mtime long, size long, content_hash string"


def watch(spark: SparkSession, listings: str, snapshot: str, checkpoint: str, on_tick: Callable[[int, DataFrame], None], every: str | None = None) -> StreamingQuery:
    """Starts a query over Parquet listings that arrive in a folder; on_tick gets the number and the actions of each batch.

    The snapshot is a folder of versions, one for each batch: a batch that is run again writes its own version again.
    Without a period, what is there is worked off once.
    """

    def tick(batch: DataFrame, number: int) -> None:
        before = index_snapshot(spark, snapshot, number)
        on_tick(number, index.classify(batch, before))
        index.upserted(before, batch, "path").write.mode("overwrite").parquet(f"{snapshot}/version={number + 1}")

    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(listings)
    writer = stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def index_snapshot(spark: SparkSession, snapshot: str, number: int) -> DataFrame:
    """The snapshot before a batch; empty before the first."""
    if number == 0:
        return spark.createDataFrame([], LISTING)
    return spark.read.schema(LISTING).parquet(f"{snapshot}/version={number}")
