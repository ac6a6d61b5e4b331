"""Connected components of a graph given as rows (a, b) of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root): each id of an edge with the smallest id that it reaches.

    Each round, every id takes its smallest neighbour (or itself), then that one's choice, and the edges are drawn
    anew between the ids chosen: the graph shrinks until no edge is left. Rounds are written to the shared folder,
    which cuts their lineage. An id with very many edges is a skewed key of a plain inner join, which Spark splits.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{label}-0")
    rounds: list[DataFrame] = []
    while edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
        onto = choice.select(F.col("id").alias("root"), F.col("root").alias("top"))
        chosen = written(choice.join(onto, "root").select("id", F.col("top").alias("root")), f"{label}-{len(rounds)}-ids")
        rounds.append(chosen)
        at = lambda c: chosen.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        drawn = edges.join(at("a"), "a").join(at("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = written(drawn, f"{label}-{len(rounds)}")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("id").alias("root"), F.col("root").alias("top"))
        found = rounds.pop().join(later, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return written(found, f"{label}-found")
