"""Incremental indexing: what changed between a snapshot and a listing, and applying it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import files as fx


def classify(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, content_hash, action) for a listing (path, mtime, size, content_hash) against a snapshot of the same columns.

    reused: same time and size; touched: same content; renamed: new, and the content is of a path that is gone; else parsed.
    """
    old = snapshot.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("content_hash").alias("_h"))
    held = listing.join(old, "path", "left")
    gone = snapshot.join(listing.select("path"), "path", "left_anti").select("content_hash").distinct().withColumn("_gone", F.lit(True))
    held = held.join(gone, "content_hash", "left")
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    action = (
        F.when(F.col("_h").isNull() & F.col("_gone"), "renamed").when(F.col("_h").isNull(), "parsed").when(same, "reused").when(F.col("content_hash") == F.col("_h"), "touched").otherwise("parsed")
    )
    return held.select("path", "content_hash", action.alias("action"))


def selected(listing: DataFrame, max_bytes: int = 1_000_000, excluded: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """listing (path, size, ...) with language: sources of at most max_bytes, without excluded folders and those a caller names.

    With within, paths or folders, only what they name or hold.
    """
    below = lambda names: F.exists(F.array(*[F.lit(n.rstrip("/")) for n in names]), lambda n: (F.col("path") == n) | F.col("path").startswith(F.concat(n, F.lit("/"))))
    held = listing.where(fx.is_source(F.col("path")) & ~fx.is_excluded(F.col("path")) & (F.col("size") <= max_bytes))
    if excluded:
        held = held.where(~below(excluded))
    if within:
        held = held.where(below(within))
    return held.withColumn("language", fx.language(F.col("path")))


def status(files: DataFrame, symbols: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: files, symbols, the time of the last indexing, files that are stale, and whether the index is fresh.

    files has last_indexed; actions are those of classify().
    """
    a = files.agg(F.count(F.lit(1)).alias("files"), F.max("last_indexed").alias("last_indexed"))
    b = symbols.agg(F.count(F.lit(1)).alias("symbols"))
    c = actions.agg(F.count_if(F.col("action").isin("parsed", "renamed")).alias("stale"))
    return a.crossJoin(b).crossJoin(c).withColumn("fresh", F.col("stale") == 0)


def removed(listing: DataFrame, snapshot: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(path) of files of the snapshot, or of a scope of paths, that the listing lacks."""
    owned = snapshot.select("path") if scope is None else snapshot.select("path").join(scope, "path", "left_semi")
    return owned.join(listing.select("path"), "path", "left_anti")


def report(actions: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of counters."""
    made = actions.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("action") == "parsed").alias("parsed"), F.count_if(F.col("action").isin("reused", "touched")).alias("reused"),
        F.count_if(F.col("action") == "renamed").alias("renamed"),
    )
    return made.crossJoin(gone.agg(F.count(F.lit(1)).alias("removed")))


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A table with all rows of the keys in new replaced by new's."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def nested_entries(files: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """One nested document for each file: its imports, and its symbols with the calls in them."""
    c = calls.groupBy(F.col("symbol_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line", "character", "callee", "receiver"))).alias("calls"))
    s = symbols.join(c, "id", "left").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", "qualified", "kind", "calls"))).alias("symbols"))
    i = imports.groupBy("file_id").agg(F.sort_array(F.collect_list("module")).alias("imports"))
    return files.withColumnRenamed("id", "file_id").join(s, "file_id", "left").join(i, "file_id", "left")
