"""Change impact, risk and the summary of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import files as fx
from graphloom.functions import text as tx
from graphloom.operators import graph as g
from graphloom.operators import intervals


def touching(spans: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of spans (path, start_line, end_line, ...) that a changed interval of their path overlaps, once each."""
    ranges = changed.select("path", F.col("start").alias("_from"), F.col("end").alias("_to"))
    return intervals.touching(spans, ranges, ["path"], ("start_line", "end_line"), ("_from", "_to"))


def risk(callers: Column, has_route: Column, exported: Column, is_test: Column, tests: Column) -> tuple[Column, Column]:
    """(score, level) of a changed symbol."""
    score = (
        F.when(callers >= 10, 2).when(callers >= 3, 1).otherwise(0)
        + F.when(has_route, 2).otherwise(0)
        + F.when(exported & ~is_test, 1).otherwise(0)
        + F.when((tests == 0) & ~is_test, 1).otherwise(0)
    )
    return score, F.when(score <= 1, "low").when(score <= 3, "medium").otherwise("high")


def caller_counts(graph, symbols: DataFrame) -> DataFrame:
    """(id, callers, caller_files, tests) of symbols: call sites, files that call it, test files among these.

    Sites are summed by name, receiver and file before symbols meet them. A symbol with a container is called by the
    sites of its name without a receiver, and by those with its container: files of these count where the first have none.
    """
    place = graph.symbol_rows.select(F.col("id").alias("symbol_id"), "path", "is_test")
    sites = graph.calls.join(place, "symbol_id").groupBy("callee", "receiver", "path", "is_test").agg(F.count(F.lit(1)).alias("n"))
    counts = lambda files, n, t: (F.count(F.lit(1)).alias(files), F.sum("n").alias(n), F.count_if("is_test").alias(t))
    free = sites.where("receiver IS NULL").drop("receiver")
    bound = sites.where("receiver IS NOT NULL")
    a = free.groupBy("callee").agg(*counts("f_files", "f_n", "f_tests"))
    b_n = bound.groupBy("callee", "receiver").agg(F.sum("n").alias("b_n"))
    b = bound.join(free.select("callee", "path"), ["callee", "path"], "left_anti").groupBy("callee", "receiver").agg(F.count(F.lit(1)).alias("b_files"), F.count_if("is_test").alias("b_tests"))
    every = sites.groupBy("callee", "path", "is_test").agg(F.sum("n").alias("n")).groupBy("callee").agg(*counts("e_files", "e_n", "e_tests"))
    at = symbols.select("id", F.col("name").alias("callee"), F.col("container").alias("receiver"))
    held = at.join(a, "callee", "left").join(b_n, ["callee", "receiver"], "left").join(b, ["callee", "receiver"], "left").join(every, "callee", "left").fillna(0)
    pick = lambda e, f, b: F.when(F.col("receiver").isNull(), F.col(e)).otherwise(F.col(f) + F.col(b))
    return held.select("id", pick("e_n", "f_n", "b_n").alias("callers"), pick("e_files", "f_files", "b_files").alias("caller_files"), pick("e_tests", "f_tests", "b_tests").alias("tests"))


def impact(graph, changed: DataFrame) -> DataFrame:
    """(id, qualified, path, callers, caller_files, tests, score, level): each changed symbol with what it bears on.

    Callers are call sites; tests are the test files among the files that call it.
    """
    hit = touching(graph.symbol_rows, changed)
    held = hit.join(caller_counts(graph, hit), "id")
    score, level = risk(F.col("callers"), F.col("route_path").isNotNull(), F.col("exported"), F.col("is_test"), F.col("tests"))
    return held.select("id", "qualified", "path", "callers", "caller_files", "tests", score.cast("long").alias("score"), level.alias("level"))


def reasons(impacts: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """(id, score, reasons): why a changed symbol is a risk, in the order of the score's parts."""
    own = symbol_rows.select("id", "route_path", "exported", "is_test")
    held = impacts.join(own, "id")
    parts = F.array(
        F.when(F.col("callers") >= 3, F.format_string("%d call sites", "callers")),
        F.when(F.col("route_path").isNotNull(), F.concat(F.lit("handles "), "route_path")),
        F.when(F.col("exported") & ~F.col("is_test"), F.lit("exported")),
        F.when((F.col("tests") == 0) & ~F.col("is_test"), F.lit("no test calls it")),
    )
    return held.select("id", "score", F.array_compact(parts).alias("reasons"))


def blast_radius(graph, changed: DataFrame) -> DataFrame:
    """(kind, name): changed symbols, their callers, the test files among the callers' files, and routes of changed symbols or callers."""
    hit = touching(graph.symbol_rows, changed)
    own = hit.select("id", "name", "container")
    sites = g.callers(graph.calls, own).select(F.col("caller_id").alias("id")).distinct()
    callers = graph.symbol_rows.join(sites, "id", "left_semi")
    both = hit.select("qualified", "route_path").unionByName(callers.select("qualified", "route_path"))
    of = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col(rows.columns[0]).alias("name")).distinct()
    made = of("symbol", hit.select("qualified")).unionByName(of("caller", callers.select("qualified")))
    return made.unionByName(of("test", callers.where("is_test").select("path"))).unionByName(of("route", both.where("route_path IS NOT NULL").select("route_path")))


def ranked(counts: DataFrame, group: str, count: str, name: str, most: int = 20) -> DataFrame:
    """counts with place, from 1 within each group by count and then name: the first so many, and truncated where a group has more."""
    order = Window.partitionBy(group).orderBy(F.col(count).desc(), name)
    held = counts.withColumn("place", F.row_number().over(order)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(group)) > most)
    return held.where(F.col("place") <= most)


#: What a card shows at each level of detail; a level has what those before it have.
DETAILS = {"metadata": ("id", "qualified", "kind", "path"), "structure": ("start_line", "end_line", "fan_in", "fan_out", "callees"), "signature": ("signature",)}


def card_details(cards: DataFrame, detail: str) -> DataFrame:
    """The columns of cards() up to a level of detail."""
    names = list(DETAILS)
    if detail not in names:
        raise ValueError(f"no such detail: {detail}; there are {', '.join(names)}")
    return cards.select(*[c for n in names[: names.index(detail) + 1] for c in DETAILS[n]])


def impact_summary(impacts: DataFrame) -> DataFrame:
    """One row: symbols, untested symbols, call sites, changed files, highest level."""
    return impacts.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("tests") == 0).alias("untested"), F.sum("callers").alias("callers"),
        F.countDistinct("path").alias("files"), F.max("score").alias("top_score"), F.count_if(F.col("level") == "high").alias("high"),
    )


def affected_files(graph, changed: DataFrame) -> DataFrame:
    """(path): files that import a changed file, other than the changed ones."""
    paths = changed.select("path").distinct()
    touched = graph.files.join(paths, "path", "left_semi").select("id", "path")
    users = g.dependents(graph.imports, graph.files).join(touched.select("id"), "id", "left_semi").select(F.col("dependent_id").alias("id")).distinct()
    return graph.files.join(users, "id", "left_semi").select("path").join(paths, "path", "left_anti")


def modules(files: DataFrame, most: int = 20) -> DataFrame:
    """(module, files, first_paths): files by folder, with the first paths of each."""
    held = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("module"), "path")
    rank = Window.partitionBy("module").orderBy("path")
    first = held.withColumn("rn", F.row_number().over(rank))
    return first.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rn") <= most, F.col("path")))), ",").alias("first_paths"))


def layers(files: DataFrame) -> DataFrame:
    """(layer, files): files by the first layer that a word of their path names."""
    return files.select(fx.layer(tx.path_words(F.col("path"))).alias("layer")).where("layer IS NOT NULL").groupBy("layer").agg(F.count(F.lit(1)).alias("files"))


#: Names at which programs begin (fixed values).
ENTRY_POINTS = ("main", "handler", "lambda_handler", "run", "serve")


def entry_points(symbol_rows: DataFrame) -> DataFrame:
    """Symbols at which a program is entered: of an entry name and of no container, or with a route."""
    return symbol_rows.where((F.col("name").isin(*ENTRY_POINTS) & F.col("container").isNull()) | F.col("route_path").isNotNull()).select("qualified", "path", "start_line")


def totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, test files, symbols."""
    a = files.agg(F.count(F.lit(1)).alias("files"), F.count_if("is_test").alias("test_files"))
    return a.crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols")))


def cards(graph) -> DataFrame:
    """One row for each symbol: its place, signature, fan-in and fan-out, and the names of up to 20 functions it calls."""
    fans = g.fan_counts(graph.calls, graph.symbols)
    called = graph.calls.select(F.col("symbol_id").alias("id"), "callee").distinct()
    rank = Window.partitionBy("id").orderBy("callee")
    names = called.withColumn("rn", F.row_number().over(rank)).where("rn <= 20").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("callee")), ",").alias("callees"))
    held = graph.symbol_rows.join(fans, "id").join(names, "id", "left")
    return held.select("id", "qualified", "kind", "path", "start_line", "end_line", "signature", "fan_in", "fan_out", F.coalesce("callees", F.lit("")).alias("callees"))


def snippets(texts: DataFrame, first: int, last: int, max_bytes: int) -> DataFrame:
    """(path, snippet, withheld): lines first to last of each text; a snippet over the budget is withheld, never cut."""
    part = F.array_join(F.slice(F.split("text", "\n"), first, last - first + 1), "\n")
    over = F.octet_length(part) > max_bytes
    return texts.select("path", F.when(~over, part).alias("snippet"), over.alias("withheld"))
