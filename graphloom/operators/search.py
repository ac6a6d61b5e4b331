"""Ranked search of symbols by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import tokenize

K1, B = 1.2, 0.75


def documents(symbol_rows: DataFrame) -> DataFrame:
    """(id, path, start_line, qualified, tokens) of each symbol: its qualified name, signature and path."""
    text = F.concat_ws(" ", "qualified", "signature", "path")
    return symbol_rows.select("id", "path", "start_line", "qualified", tokenize(text).alias("tokens"))


def idf(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of all terms."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, qualified, path, start_line, score) of the best documents with a score, best first, then by path, line and id.

    Corpus statistics are one aggregate over all documents (one row); scores are computed where a document is.
    """
    spark = docs.sparkSession
    terms = spark.range(1).select(F.array_distinct(tokenize(F.lit(query))).alias("t")).first()["t"]
    if not terms:
        return docs.select("id", "qualified", "path", "start_line", F.lit(0.0).alias("score")).limit(0)
    has = [F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean"), *has)
    held = docs.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = F.size("tokens") - F.size(F.array_remove("tokens", t))
        weight = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("tokens") / F.col("mean")))
    found = held.withColumn("score", score).where("score > 0")
    return found.orderBy(F.round("score", 9).desc(), "path", "start_line", "id").limit(limit).select("id", "qualified", "path", "start_line", "score")
