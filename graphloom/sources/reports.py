"""Text and JSON that come from and go to other tools: coverage, diffs, baselines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import findings


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files, each read whole; n counts from 1."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return rows.select("file", (F.col("n") + 1).cast("long").alias("n"), "line")


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits) of LCOV reports."""
    return findings.lcov_hits(numbered_lines(spark, path))


def diff(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, end) of unified diffs without context."""
    return findings.hunk_ranges(numbered_lines(spark, path))


_ENTRY = "rule_id: string, path: string, evidence: string, severity: string, count: long"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline document; version 1 has no counts, each entry stands for one. Other versions and counts under one are errors."""
    doc = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(f"version int, findings array<struct<{_ENTRY}>>").json(path)
    versions = [r[0] for r in doc.select("version").distinct().collect()]
    if len(versions) != 1 or versions[0] not in (1, 2):
        raise ValueError(f"unknown baseline version: {', '.join(map(str, versions)) or None}")
    rows = doc.select(F.explode("findings").alias("f")).select("f.*")
    if versions[0] == 1:
        return rows.withColumn("count", F.lit(1).cast("long"))
    return rows.withColumn("count", F.when(F.col("count") >= 1, F.col("count")).otherwise(F.raise_error(F.lit("a baseline count must be 1 or more")).cast("long")))


def write_baseline(known: DataFrame, path: str, per_document: int = 10_000) -> None:
    """A baseline as documents that read_baseline reads, one in each file, of about per_document entries."""
    parts = max(1, -(-known.count() // per_document))
    entry = F.struct("rule_id", "path", "evidence", "severity", "count")
    dealt = known.groupBy(F.pmod(F.xxhash64("rule_id", "path", "evidence"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("findings"))
    if known.isEmpty():
        dealt = known.sparkSession.range(1).select(F.col("id").alias("part"), F.array().cast(f"array<struct<{_ENTRY}>>").alias("findings"))
    doc = F.to_json(F.struct(F.lit(2).alias("version"), "findings"))
    dealt.select("part", doc.alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_sarif(found: DataFrame, path: str) -> None:
    """SARIF results, one on a line."""
    findings.sarif_results(found).select("json").write.mode("overwrite").text(path)
