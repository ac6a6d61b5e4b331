"""What only shows in long texts and large tables."""

import random
import re

from pyspark.sql import functions as F


def test_long_runs_of_one_word_are_judged(spark):
    """A line of very many equal words; matched by a pattern that calls itself for each word, it ended the executor."""
    from graphloom.llm.quality_rules import clean, run_length

    made = spark.createDataFrame([(1, "buy " * 200_000), (2, "a b\n" + "so " * 30_000 + "it goes")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_repeat_words, r.kept, r.clean_text) for r in clean(made).collect()} == {1: (200_000, 200_000, False, ""), 2: (30_004, 30_000, False, "a b")}

    r = random.Random(1)
    lines = ["".join(r.choice(["a", "b", "ab", " ", "  ", "\t"]) + r.choice(["", " ", " a a a"]) for _ in range(r.randrange(40))) for _ in range(500)]
    run = re.compile(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?=[\x20\x09-\x0D]|\Z)){4,}")
    made = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    got = {x.i: x.n for x in made.select("i", run_length(F.col("line"), 5).alias("n")).collect()}
    want = {i: len(x) - len(run.sub("", x)) for i, x in enumerate(lines)}
    assert got == want and sum(n > 0 for n in want.values()) > 50


def test_the_block_tables_are_not_broadcast(spark):
    """Spark takes the exploded tables for as small as the fingerprints and would send the whole index to the driver."""
    from graphloom.llm.fingerprints import counted

    index = spark.range(3000).select(F.xxhash64("id").alias("f0"), F.xxhash64("id", F.lit(1)).alias("f1"))
    made = counted(index.limit(30), index)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x and "b#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins), plan
    assert made.count() == 30
