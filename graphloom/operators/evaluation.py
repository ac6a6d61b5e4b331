"""Precision and recall, and paired trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(pairs: DataFrame) -> DataFrame:
    """One row for (expected, found) booleans; 0 of 0 is 1."""
    n = lambda c: F.count_if(c)
    made = pairs.agg(n(F.col("expected") & F.col("found")).alias("tp"), n(~F.col("expected") & F.col("found")).alias("fp"), n(F.col("expected") & ~F.col("found")).alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return made.withColumn("precision", F.round(ratio("tp", "fp"), 6)).withColumn("recall", F.round(ratio("tp", "fn"), 6))


def arms(trials: DataFrame) -> DataFrame:
    """(arm, trials, scored, mean_reward) of trials (task, arm, reward); missing rewards aren't in the mean."""
    return trials.groupBy("arm").agg(F.count(F.lit(1)).alias("trials"), F.count("reward").alias("scored"), F.round(F.avg("reward"), 6).alias("mean_reward"))


def paired(trials: DataFrame, control: str, treatment: str) -> DataFrame:
    """One row: tasks matched and scored, wins, losses and ties of the treatment, mean difference, tasks of one arm only."""
    mean = trials.groupBy("task", "arm").agg(F.avg("reward").alias("reward"))
    a = mean.where(F.col("arm") == control).select("task", F.col("reward").alias("a"), F.lit(True).alias("in_a"))
    b = mean.where(F.col("arm") == treatment).select("task", F.col("reward").alias("b"), F.lit(True).alias("in_b"))
    held = a.join(b, "task", "full_outer").withColumn("d", F.col("b") - F.col("a"))
    both = F.col("in_a") & F.col("in_b")
    return held.agg(
        F.count_if(both).alias("matched"), F.count_if(both & F.col("d").isNotNull()).alias("scored"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"),
        F.count_if(F.col("d") == 0).alias("ties"), F.round(F.avg("d"), 6).alias("mean_delta"), F.count_if(F.col("in_b").isNull()).alias("control_only"), F.count_if(F.col("in_a").isNull()).alias("treatment_only"),
    )
