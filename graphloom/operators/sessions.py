"""Sessions as a batch: budgets, replays, cached results and scope."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def retry_budget(events: DataFrame, max_retries: int = 3, no_progress: int = 2) -> DataFrame:
    """events (session, at, state) with attempts, stalled and exhausted.

    Attempts count within a run of one state; a new state begins anew. Stalled is how often the state stayed as it was.
    """
    order = Window.partitionBy("session").orderBy("at", "event_id")
    new = F.coalesce((F.lag("state").over(order) != F.col("state")).cast("int"), F.lit(1))
    held = events.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("session", "run").orderBy("at", "event_id"))
    held = held.withColumn("attempts", place.cast("long")).withColumn("stalled", (F.col("attempts") - 1))
    over = (F.col("attempts") > max(1, max_retries)) | (F.col("stalled") >= max(1, no_progress))
    return held.withColumn("exhausted", over).drop("_new", "run")


def replays(events: DataFrame, window_micros: int) -> DataFrame:
    """events (session, state, at in microseconds) with replayed: within the window of the first evaluation, which replays do not move.

    Events are dealt by session and state and streamed in order; a task carries one time along, however long a session is.
    """
    columns = events.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor = None, 0
        for batch in batches:
            session, state, at = (batch.column(columns.index(c)) for c in ("session", "state", "at"))
            replayed = []
            for s, t, x in zip(session.to_pylist(), state.to_pylist(), at.cast(pa.int64()).to_pylist(), strict=True):
                if (s, t) != group or x - anchor >= window_micros:
                    group, anchor = (s, t), x
                replayed.append(x != anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replayed, pa.bool_())], [*columns, "replayed"])

    dealt = events.repartition("session", "state").sortWithinPartitions("session", "state", "at", "event_id")
    return dealt.mapInArrow(fold, T.StructType([*events.schema.fields, T.StructField("replayed", T.BooleanType())]))


def cached(events: DataFrame, ttl_micros: int) -> DataFrame:
    """events (event_id, state, at, success) with hit: an earlier success of the same state is no older than the time to live."""
    order = Window.partitionBy("state").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("success"), F.col("at"))).over(order)
    return events.withColumn("hit", F.coalesce(F.col("at") - last <= ttl_micros, F.lit(False)))


def outside_scope(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """(session, path) that no scope of the session holds: a scope is a path or a folder above it, or . for everything."""
    s = scopes.select("session", F.col("scope"))
    p = paths.alias("p")
    holds = (F.col("s.scope") == ".") | (F.col("p.path") == F.col("s.scope")) | F.col("p.path").startswith(F.concat("s.scope", F.lit("/")))
    return p.join(s.alias("s"), (F.col("p.session") == F.col("s.session")) & holds, "left_anti")


def last_states(events: DataFrame, most: int = 16) -> DataFrame:
    """The last events of each session, 16 by default."""
    order = Window.partitionBy("session").orderBy(F.col("at").desc(), F.col("event_id").desc())
    return events.withColumn("age", F.row_number().over(order).cast("long")).where(F.col("age") <= most)
