"""Operator 10, mixing sources to target weights.

The sizes of each source are summed, targets follow from weights and caps, and
each document is emitted floor(rate) times plus one more by a draw: a number in
[0, 1) that a hash of its id and a seed decide, the same for every run. The
probability is the rate's fraction; the draw takes the documents of a source in
the order of their numbers until its words come to the target, so what luck would
add or leave out is evened within the source and each document is as likely.
Numbers are rounded to 1 / STEPS for this, so the sums behind it are few.

The target table has one row for each source; it is joined by broadcast when
small enough, otherwise by a shuffle with hot sources apart.

Defined results: a null or empty text has size 0 and takes 0 words; a null
source is a source of its own, after all others; a null doc_id draws as the
string "null"; repeated rows draw alike; an empty table gives an empty result;
other columns pass through ``mix`` unless their name is one of OUTPUT, which is
then replaced (so are _name, _step, _rows and _mix). Ties between sources do not arise: a
source's name is its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, numbered, partitions_for, read, written

#: Draws are told apart by so many steps.
STEPS = 4096
OUTPUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that a key and a seed decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.coalesce(key.cast("string"), F.lit("null"))), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, rows, source_size, target). Sources in code-point order, null last, take the weights in turn.

    A target stops at cap times the source's size; what is over is shared anew by weight until none is above.
    One row for each source; each round is an aggregate over that table, and a round caps a source at least.
    """
    order = [F.col("source").isNull(), F.col("source")]
    held = sizes.withColumn("_all", F.lit(0)).repartitionByRange(partitions_for(sizes.sparkSession), *order).sortWithinPartitions(*order)
    rank = numbered(held, "_all", "rank", "mix-order").drop("_all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(rank.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, F.lit(False)
    while True:
        held, free = table.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("w")))).first()
        if not free:
            break
        now = max(0.0, total - (held or 0.0)) / free
        if now <= level:
            break
        level = now
        capped = F.col("w") * F.lit(level) > F.col("most")
    return table.select("source", "rows", "source_size", F.least(F.col("most"), F.col("w") * F.lit(max(level, 0.0))).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 10,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """docs with the columns of OUTPUT; ``copies`` says how often the mix has the document.

    The targets are broadcast if there are at most broadcast_rows sources, otherwise they are joined by a shuffle.
    """
    # sources by a name that is never null, in code-point order
    name = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    sized = docs.drop(*OUTPUT, "_name", "_step", "_rows", "_mix").withColumns({"size": word_count(F.col(text)), "_name": name, "_step": F.floor(draw(F.col(key), seed) * STEPS).cast("int")})
    steps = written(sized.groupBy("_name", "_step").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.any_value(F.col(source)).alias("source")), "mix-steps")
    per = targets(steps.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    per = per.select(named.alias("_name"), "rows", "source_size", "target", F.floor(rate).cast("int").alias("whole"), (F.col("target") - F.floor(rate) * F.col("source_size")).alias("more"))
    # the last step that is drawn: with it, the words drawn are nearer to those that are due than without it
    upto = F.sum("words").over(Window.partitionBy("_name").orderBy("_step"))  # STEPS rows of a source at most
    drawn = steps.withColumn("upto", upto).join(per.select("_name", "more"), "_name").where(F.col("upto") - F.col("words") / 2 < F.col("more"))
    per = written(per.drop("more").join(drawn.groupBy("_name").agg(F.max("_step").alias("last")), "_name", "left"), "mix-targets")
    small = per.select("_name", F.col("rows").alias("_rows"), F.struct("source_size", "target", "whole", "last").alias("_mix"))
    if per.count() <= broadcast_rows:
        joined = sized.join(F.broadcast(small.drop("_rows")), "_name")
    else:
        joined = join_hot(sized, small, "_name", "_rows", per.agg(F.sum("rows")).first()[0])
    copies = F.least(F.lit(int(cap)), F.col("_mix.whole") + F.coalesce(F.col("_step") <= F.col("_mix.last"), F.lit(False)).cast("int"))
    joined = joined.withColumns({"source_size": F.col("_mix.source_size"), "target": F.col("_mix.target")})
    made = joined.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return made.select(*[c for c in sized.columns if c not in ("size", "_name", "_step")], *OUTPUT)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document of mix() as often as the mix has it, with the columns that docs had."""
    repeated = mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.drop("_copy", *OUTPUT)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
