import collections

from graphloom.llm import common
from graphloom.llm.components import components
from pyspark.sql import functions as F


def test_join_hot_is_a_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).alias("k"))
    small = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most")).where("k % 5 <> 0")
    for how in ("inner", "left"):
        tidy = lambda df: sorted((r.id, r.k, r.most or -1) for r in df.collect())
        assert tidy(common.join_hot(rows, small, "k", "n", 5000, how)) == tidy(rows.join(small, "k", how))


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).repartition(7).select("id", (F.col("id") % 4).cast("int").alias("g"))
    got = collections.defaultdict(list)
    for r in common.numbered(rows, "g", "n", "test").collect():
        got[r.g].append(r.n)
    assert all(sorted(v) == list(range(250)) for v in got.values()) and len(got) == 4


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    loops = [(1, 1), (2, 3), (3, 2)]
    edges = spark.createDataFrame(chain + star + loops, "a long, b long")
    want = {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in (5, *range(200, 260))}, 2: 2, 3: 2}
    assert {r.id: r.root for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0


def test_other_ways_of_size_checked_joins(spark):
    from graphloom.llm.mixing import mix
    from graphloom.llm.warc import decide

    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, mix(docs, broadcast_rows=0).collect()))
    pages = spark.createDataFrame([(i, "u", "x" * 2000 if i % 2 else f"{i}" * 2000) for i in range(50)], "page_id long, url string, html string")
    got = {r.key: r.refers_to for r in decide(pages, "page_id", "html", 1000, broadcast_rows=0).collect()}
    assert got == {r.key: r.refers_to for r in decide(pages, "page_id", "html", 1000).collect()} == {i: 49 if i % 2 and i != 49 else None for i in range(50)}
