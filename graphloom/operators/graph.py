"""Lookups, patterns and edges of the code graph.

Patterns are what a read-only graph query asks for (a labelled node, or two
nodes and a relation, with filters, properties and a limit), as a DataFrame API:
Catalyst plans them, so there is no query text to parse.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx

#: Kinds of symbols that a label stands for (fixed values).
LABELS = {"Function": "function", "Method": "method", "Type": "type", "Module": "module", "Route": None, "File": None}
RELATIONS = {"CALLS", "CALLED_BY", "EXTENDS", "IMPLEMENTED_BY", "CONTAINS", "IMPORTS", "DEPENDS_ON", "ROUTES_TO"}
PROPERTIES = ("name", "qualified", "kind", "path", "line", "signature", "exported", "is_test", "route_method", "route_path")


def find_symbols(symbols: DataFrame, query: str, escape: bool = True) -> DataFrame:
    """Symbols of this name or qualified name; only if there is none, those that contain it, in any case."""
    exact = symbols.where((F.col("qualified") == query) | (F.col("name") == query))
    like = symbols.where(F.lower("qualified").like(tx.like_of_substring(query, escape)))
    none = exact.agg((F.count(F.lit(1)) == 0).alias("none"))
    return exact.unionByName(like.crossJoin(F.broadcast(none)).where("none").drop("none"))


def match_symbols(symbols: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    """Symbols whose qualified name matches a pattern with * and ?, or contains it."""
    found = symbols.where(F.lower("qualified").like(tx.like_of_wildcard(pattern)))
    return found.where(F.col("kind") == kind) if kind else found


def nodes(symbol_rows: DataFrame, files: DataFrame, label: str) -> DataFrame:
    """Nodes of a label with the ten properties as strings, empty where a node has none."""
    if label not in LABELS:
        raise ValueError(f"no such label: {label}; there are {', '.join(LABELS)}")
    if label == "File":
        empty = F.lit("")
        own = {"name": F.col("stem"), "qualified": F.col("path"), "path": F.col("path"), "kind": F.lit("file")}
        return files.select("id", F.col("path").alias("_path"), F.lit(0).cast("long").alias("_line"), *[own.get(p, empty).alias(p) for p in PROPERTIES])
    rows = symbol_rows.where(F.col("route_path").isNotNull() if label == "Route" else F.col("kind") == LABELS[label])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("id", F.col("path").alias("_path"), F.col("start_line").alias("_line"), *[text("start_line" if p == "line" else p).alias(p) for p in PROPERTIES])


def filtered(node: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Nodes whose properties equal the values in any case; values with * or ? are patterns for the whole property."""

    def one(prop: str, value: str) -> Column:
        low = F.lower(F.col(prop))
        return low.like(tx.like_of_glob(value)) if "*" in value or "?" in value else low == value.lower()

    return node.where(reduce(lambda a, b: a & b, [one(p, v) for p, v in filters.items()], F.lit(True)))


def match_nodes(symbol_rows: DataFrame, files: DataFrame, label: str, where: dict[str, str] | None = None, returns: tuple[str, ...] = ("name",), limit: int | None = None) -> DataFrame:
    """The returned properties of a label's nodes that pass the filters; with a limit, the first in the order of path and line."""
    found = filtered(nodes(symbol_rows, files, label), where or {})
    if limit is not None:
        found = found.orderBy("_path", "_line", "id").limit(limit)
    return found.select(*returns)


#: Tables that rows multiply with are broadcast up to so many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 2_000_000


def _small(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(df, written; what marks its parts for broadcast, if it is small by count): what a broadcast table multiplies is not shuffled."""
    from graphloom.operators.trace import _cut

    held = _cut(df)
    return held, F.broadcast if held.count() <= BROADCAST_ROWS else lambda x: x


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df, written, in as many parts as the session shuffles into: rows that multiply take long, however few they are."""
    from graphloom.operators.trace import _cut

    return _cut(df).repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), *by)


def callees(calls: DataFrame, symbols: DataFrame, a: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
    """(symbol_id, id): symbols that a symbol calls: of the called name, and of the receiver if the call has one. A set; a (symbol_id, ...) and b (id, ...), if given, are joined with it.

    Pairs are as many as a name's calls times its symbols, so they are neither made twice nor shuffled: a receiver is of no interest where
    the same symbol calls the name without one, an id of one name and container meets a call once, and a and b join before names meet.
    """
    made = calls.where("callee IS NOT NULL").groupBy("symbol_id", "callee").agg(F.count_if(F.col("receiver").isNull()).alias("_free"), F.collect_set("receiver").alias("_bound"))
    made = _dealt(made if a is None else made.join(a, "symbol_id"), "symbol_id", "callee")
    to = symbols.select("id", "name", "container").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    to, small = _small(to if b is None else to.where("_n = 1").join(b, "id").unionByName(to.where("_n > 1"), allowMissingColumns=True))
    given = [c for t, key in ((a, "symbol_id"), (b, "id")) if t is not None for c in t.columns if c != key]

    def pairs(those: str) -> DataFrame:
        own = small(to.where(those)).withColumnsRenamed({"name": "_name", "container": "_container"})
        free = made.where("_free > 0").join(own, F.col("callee") == F.col("_name"))
        bound = made.where("_free = 0").withColumn("_receiver", F.explode("_bound")).join(own, (F.col("callee") == F.col("_name")) & (F.col("_receiver") == F.col("_container")))
        return free.select("symbol_id", "id", *given).unionByName(bound.select("symbol_id", "id", *given))

    several = pairs("_n > 1")
    if a is not None:
        several = several.drop(*[c for c in a.columns if c != "symbol_id"])
    if b is not None:
        several = several.drop(*[c for c in b.columns if c != "id"])
    several = several.distinct()
    if a is not None:
        several = several.join(a, "symbol_id")
    if b is not None:
        several = several.join(b, "id")
    return pairs("_n = 1").unionByName(several)


def callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, caller_id, n): who calls a symbol, with the number of call sites.

    A call counts if it is of the symbol's name, and its receiver, if it has one, is the symbol's container, if that has one. Calls are summed for
    each container that the name's symbols have before they meet the symbols: pairs, as many as a name's callers times its symbols, are made once and not shuffled.
    """
    to, _ = _small(symbols.select("id", "name", "container"))
    kinds, few = _small(to.select(F.col("name").alias("_name"), F.col("container").alias("_container")).distinct())
    made = calls.groupBy("symbol_id", "callee", "receiver").agg(F.count(F.lit(1)).alias("n"))
    fits = (F.col("callee") == F.col("_name")) & (F.col("_container").isNull() | F.col("receiver").isNull() | (F.col("receiver") == F.col("_container")))
    met = made.join(few(kinds), fits).groupBy("_name", "_container", "symbol_id").agg(F.sum("n").alias("n"))
    met = _dealt(met, "symbol_id", "_name", "_container")
    times = to.groupBy("id", "name", "container").agg(F.count(F.lit(1)).alias("_times"))
    own, small = _small(times.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id"))))

    def pairs(those: str) -> DataFrame:
        here = (F.col("_name") == F.col("name")) & F.col("_container").eqNullSafe(F.col("container"))
        return met.join(small(own.where(those)), here).select("id", F.col("symbol_id").alias("caller_id"), (F.col("n") * F.col("_times")).alias("n"))

    return pairs("_n = 1").unionByName(pairs("_n > 1").groupBy("id", "caller_id").agg(F.sum("n").alias("n")))


def fan_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): call sites of and in each symbol. Calls are summed by name and receiver before symbols meet them."""
    sites = calls.groupBy("callee", "receiver").agg(F.count(F.lit(1)).alias("n"))
    free = sites.where("receiver IS NULL").select("callee", F.col("n").alias("free"))
    bound = sites.where("receiver IS NOT NULL")
    every = sites.groupBy("callee").agg(F.sum("n").alias("every"))
    out = calls.groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    base = symbols.select("id", F.col("name").alias("callee"), F.col("container").alias("receiver"))
    held = base.join(free, "callee", "left").join(bound, ["callee", "receiver"], "left").join(every, "callee", "left").join(out, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return held.select("id", F.when(F.col("receiver").isNull(), zero("every")).otherwise(zero("free") + zero("n")).alias("fan_in"), zero("fan_out").alias("fan_out"))


def implementors(extends: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, implementor_id): symbols that extend a symbol's name."""
    return symbols.select("id", "name").join(extends.withColumnRenamed("symbol_id", "implementor_id"), "name").select("id", "implementor_id")


def containing(names: DataFrame, symbols: DataFrame, n: int = 3) -> DataFrame:
    """(name, id, qualified, path, start_line): symbols (id, qualified, path, start_line) whose qualified name contains a name, but for case.

    They meet by pieces of n letters: a name looks among the symbols that have its rarest piece. Names shorter than n meet
    symbols by pieces of their own length.
    """

    def pieces(text, size: int):
        text = F.lower(text)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))

    found = None
    for size in range(1, n + 1):
        own = names.where(F.length("name") >= size) if size == n else names.where(F.length("name") == size)
        if size < n and not own.limit(1).count():
            continue
        held = symbols.select("id", F.explode(pieces(F.col("qualified"), size)).alias("piece"))
        counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        rarest = own.select("name", F.explode(pieces(F.col("name"), size)).alias("piece")).join(counts, "piece", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
        met = rarest.select("name", F.col("p.piece").alias("piece")).join(held, "piece").join(symbols, "id")
        met = met.where(F.expr("instr(lower(qualified), lower(name)) > 0")).select("name", "id", "qualified", "path", "start_line")
        found = met if found is None else found.unionByName(met)
    return found


def supertypes(extends: DataFrame, symbol_rows: DataFrame, most: int = 8) -> DataFrame:
    """(symbol_id, id): what a symbol extends: per name the first symbols of it, or else those that contain it."""
    names = extends.select("name").distinct()
    at = symbol_rows.select("id", F.col("name").alias("own"), "qualified", "path", "start_line")
    by_name = names.join(at, F.col("name") == F.col("own"))
    by_qualified = names.join(at, F.col("name") == F.col("qualified"))
    exact = by_name.unionByName(by_qualified).drop("own").distinct()
    rest = names.where("name <> ''").join(exact.select("name").distinct(), "name", "left_anti")
    kept = exact
    if rest.limit(1).count():
        kept = exact.unionByName(containing(rest, at.drop("own")))
    first = Window.partitionBy("name").orderBy("path", "start_line", "id")
    kept = kept.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most)
    return extends.join(kept.select("name", "id"), "name").select("symbol_id", "id")


def imported_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, id): files whose stem an import names, other than the file itself; one row for each import."""
    return imports.join(files.select("id", "stem"), "stem").where("file_id <> id").select("file_id", "id")


def dependents(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, dependent_id): files that import a file, once each."""
    return imported_files(imports, files).select("id", F.col("file_id").alias("dependent_id")).distinct()


def external_dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(module, uses): imported stems that no file has."""
    return imports.join(files.select("stem"), "stem", "left_anti").groupBy(F.col("stem").alias("module")).agg(F.count(F.lit(1)).alias("uses"))


def unresolved_calls(calls: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """Calls with a qualifier but no receiver, with the caller's path."""
    open_ = calls.where("receiver IS NULL AND qualifier IS NOT NULL AND line > 0")
    return open_.join(symbol_rows.select(F.col("id").alias("symbol_id"), "path"), "symbol_id").select("path", "callee", "qualifier", "line", "character", F.length("qualifier").alias("width"))


def service_edges(links: DataFrame, routes: DataFrame) -> DataFrame:
    """(symbol_id, method, url, route): each outbound link with the first route that fits its method and segments, null without one.

    Routes and links meet by number of segments and by the first segment of the route that is no parameter.
    """
    link = links.distinct().withColumn("segments", tx.url_segments(F.col("url"))).withColumn("k", F.size("segments"))
    to = routes.select("qualified", "path", "route_method", "route_path", tx.route_segments(F.col("route_path")).alias("own")).withColumn("k", F.size("own"))
    # a route's first segment that is no parameter, and its place; routes of parameters alone have none
    at = F.array_position(F.transform("own", lambda r: ~tx.is_parameter(r)), True).cast("int") - 1
    to = to.withColumn("at", at).withColumn("word", F.when(F.col("at") >= 0, F.lower(F.get("own", F.col("at")))))
    method = F.col("method").isNull() | F.col("route_method").isNull() | (F.lower("method") == F.lower("route_method"))
    placed = link.select("*", F.posexplode("segments").alias("at", "word")).withColumn("word", F.lower("word")).join(to.where("at >= 0"), ["k", "at", "word"])
    bare = link.join(to.where("at < 0").drop("at", "word"), "k")
    fits = placed.select(bare.columns).unionByName(bare).where(method & tx.segments_match(F.col("own"), F.col("segments")))
    first = fits.groupBy("symbol_id", "method", "url").agg(F.min(F.struct("route_path", "path", "qualified")).alias("r"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("symbol_id", "method", "url")]
    return links.alias("l").join(first.alias("f"), keys, "left").select("l.symbol_id", "l.method", "l.url", F.col("f.r.qualified").alias("route"))


def edges(graph, relation: str, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(a, b): the ids that a relation joins, of a graph with files, symbols, symbol_rows, calls, extends, imports, service_links and routes.

    left and right, tables with the ids of interest, thin what is joined before names meet and rows multiply.
    """
    if relation not in RELATIONS:
        raise ValueError(f"no such relation: {relation}; there are {', '.join(sorted(RELATIONS))}")

    def only(table: DataFrame, ids: DataFrame | None, column: str = "id") -> DataFrame:
        return table if ids is None else table.join(ids.select(F.col("id").alias(column)), column, "left_semi")

    if relation == "CALLS":
        return callees(only(graph.calls, left, "symbol_id"), only(graph.symbols, right)).toDF("a", "b")
    if relation == "CALLED_BY":
        return callers(only(graph.calls, right, "symbol_id"), only(graph.symbols, left)).select("id", "caller_id").toDF("a", "b")
    if relation == "EXTENDS":
        return supertypes(only(graph.extends, left, "symbol_id"), graph.symbol_rows).toDF("a", "b")
    if relation == "IMPLEMENTED_BY":
        return implementors(only(graph.extends, right, "symbol_id"), only(graph.symbols, left)).toDF("a", "b")
    if relation == "CONTAINS":
        return only(graph.symbols, right).select("file_id", "id").toDF("a", "b")
    if relation == "ROUTES_TO":
        found = service_edges(only(graph.service_links, left, "symbol_id"), graph.symbols.where("route_path IS NOT NULL").join(graph.files.select(F.col("id").alias("file_id"), "path"), "file_id"))
        return found.join(graph.symbols.select("id", F.col("qualified").alias("route")), "route").select("symbol_id", "id").toDF("a", "b")
    return imported_files(only(graph.imports, left, "file_id"), graph.files).toDF("a", "b")


def match_edges(graph, left: str, relation: str, right: str, where: tuple[dict[str, str], dict[str, str]] = ({}, {}), returns: tuple[str, ...] = ("a.name", "b.name"), limit: int | None = None) -> DataFrame:
    """The returned properties of pairs of nodes that a relation joins; columns are named a_name and so on."""
    file_like = {"CONTAINS": ("File", None), "IMPORTS": ("File", "File"), "DEPENDS_ON": ("File", "File")}
    for want, got in zip(file_like.get(relation, (None, None)), (left, right), strict=True):
        if (want == "File") != (got == "File"):
            raise ValueError(f"{relation} does not join {left} and {right}")
    a, b = (filtered(nodes(graph.symbol_rows, graph.files, label), f) for label, f in ((left, where[0]), (right, where[1])))
    if relation == "CALLS" and limit is None:  # what is returned joins before names meet: pairs can be very many
        sides = []
        for side, rows, key in (("a", a, "symbol_id"), ("b", b, "id")):
            own = dict.fromkeys(r[2:] for r in returns if r.startswith(f"{side}."))
            sides.append(_small(rows.select(F.col("id").alias(key), *[F.col(p).alias(f"{side}_{p}") for p in own]))[0])
        calls, symbols = graph.calls.join(sides[0].select("symbol_id"), "symbol_id", "left_semi"), graph.symbols.join(sides[1].select("id"), "id", "left_semi")
        return callees(calls, symbols, *sides).select(*[F.col(r.replace(".", "_")) for r in returns])
    found = edges(graph, relation, a if where[0] else None, b if where[1] else None).alias("e")
    found = found.join(a.alias("a"), F.col("e.a") == F.col("a.id")).join(b.alias("b"), F.col("e.b") == F.col("b.id"))
    if limit is not None:
        found = found.orderBy("a._path", "a._line", "a.id", "b._path", "b._line", "b.id").limit(limit)
    return found.select(*[F.col(r).alias(r.replace(".", "_")) for r in returns])
