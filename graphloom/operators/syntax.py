"""Rules on syntax nodes: a node says how many loops and which function hold it, so rules filter and sum, and nodes never meet each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import domain_tokens


#: Kinds and columns of nodes that complexity reads.
COUNTED = ("function", "branch", "loop", "handler")
COUNTED_COLUMNS = ("node_id", "kind", "name", "start_line", "end_line", "function_id")


def complexity(nodes: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line, complexity): 1 and the branches, loops and handlers of a function, not those of functions in it."""
    inner = nodes.where(F.col("kind").isin("branch", "loop", "handler") & F.col("function_id").isNotNull())
    made = inner.groupBy("file_id", F.col("function_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    own = nodes.where("kind = 'function'").select("file_id", "node_id", "name", "start_line", "end_line")
    return own.join(made, ["file_id", "node_id"], "left").select("file_id", "name", "start_line", "end_line", (1 + F.coalesce("n", F.lit(0))).alias("complexity"))


def nested_loops(nodes: DataFrame) -> DataFrame:
    """(file_id, start_line, depth): loops in loops, but for loops over a range of stated numbers."""
    return nodes.where("kind = 'loop' AND depth > 0 AND NOT bounded").select("file_id", "start_line", "depth")


#: Methods that scan or sort a collection (fixed values).
LOOKUPS = ("index", "count", "remove", "find", "filter")
SORTS = ("sort", "sorted")


def calls_in_loops(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(file_id, start_line, name): calls of these functions or methods that a loop holds."""
    return nodes.where((F.col("kind") == "call") & (F.col("depth") > 0) & F.substring_index("name", ".", -1).isin(*names)).select("file_id", "start_line", "name")


def swallowed(nodes: DataFrame) -> DataFrame:
    """(file_id, start_line): handlers that do nothing."""
    return nodes.where("kind = 'handler' AND name = 'empty'").select("file_id", "start_line")


def large_literals(nodes: DataFrame, lines: int = 80, children: int = 50) -> DataFrame:
    """(file_id, start_line, end_line): literals of many lines or parts that are no part of another."""
    large = (F.col("end_line") - F.col("start_line") + 1 >= lines) | (F.col("size") >= children)
    return nodes.where((F.col("kind") == "literal") & large & ~F.col("parent_kind").eqNullSafe("literal")).select("file_id", "start_line", "end_line")


def parse_errors(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'error'").select("file_id", "start_line", F.col("name").alias("error"))


def renamed_duplicates(functions: DataFrame) -> DataFrame:
    """(first_file, first_name, file_id, name): functions of one canonical form and different text; each with the first of its form."""
    form = F.md5(F.col("canonical").cast("binary"))
    held = functions.withColumn("form", form).withColumn("text", F.md5(F.col("original").cast("binary")))
    first = held.groupBy("form").agg(F.min(F.struct("file_id", "start_line", "name", "text")).alias("f"), F.countDistinct("text").alias("n")).where("n > 1")
    found = held.join(first, "form").where(F.col("text") != F.col("f.text"))
    return found.select(F.col("f.file_id").alias("first_file"), F.col("f.name").alias("first_name"), "file_id", "name")


def behavioural_duplicates(functions: DataFrame, least_calls: int = 3) -> DataFrame:
    """(first_file, first_name, file_id, name, domain): functions that share a domain word and call the same three or more functions, in different forms."""
    held = functions.where(F.size("calls") >= least_calls).select("file_id", "start_line", "name", F.explode(F.array_distinct(domain_tokens(F.col("name")))).alias("domain"), F.array_join("calls", ",").alias("behaviour"), F.md5(F.col("canonical").cast("binary")).alias("form"))
    first = held.groupBy("domain", "behaviour").agg(F.min(F.struct("file_id", "start_line", "name", "form")).alias("f"), F.countDistinct("form").alias("n")).where("n > 1")
    found = held.join(first, ["domain", "behaviour"]).where(F.col("form") != F.col("f.form"))
    return found.select(F.col("f.file_id").alias("first_file"), F.col("f.name").alias("first_name"), "file_id", "name", "domain")


def reaching(calls: DataFrame, marked: DataFrame, rounds: int | None = None) -> DataFrame:
    """(name): functions that call a marked one, directly or by others, for calls (caller, callee). Joined until nothing is new.

    Each round finds a name at least, so it ends; rounds, if given, is the longest way that counts.
    """
    from itertools import count

    from graphloom.operators.trace import _cut

    found = _cut(marked.select("name").distinct())
    front = found
    pairs = _cut(calls.select("caller", "callee").distinct())
    for n in count() if rounds is None else range(rounds):
        front = _cut(pairs.join(front.withColumnRenamed("name", "callee"), "callee").select(F.col("caller").alias("name")).distinct().join(found, "name", "left_anti"))
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
        if n % 16 == 15:  # the plan stays short
            found = _cut(found)
    return found


TAINTED = "file_id long, function string, line long, sink string, variable string"


def tainted_sinks(statements: DataFrame, sources: tuple[str, ...], sinks: tuple[str, ...], sanitizers: tuple[str, ...]) -> DataFrame:
    """Sinks that a value from a source reaches, for statements (file_id, function, line, target, uses, call).

    Lines are walked in order: a target is tainted by a source or a tainted use, and clean again by a sanitizer or a clean value.
    This depends on order, so each function is folded by itself; a function is a bounded group.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        dirty: set[str] = set()
        found = []
        for r in rows.sort_values("line").itertuples():
            used = [u for u in (r.uses if r.uses is not None else []) if u in dirty]
            call = r.call or ""
            if call in sinks and used:
                found.append((r.file_id, r.function, r.line, call, used[0]))
            if r.target:
                if call in sources or used and call not in sanitizers:
                    dirty.add(r.target)
                else:
                    dirty.discard(r.target)
        return pd.DataFrame(found, columns=["file_id", "function", "line", "sink", "variable"])

    return statements.groupBy("file_id", "function").applyInPandas(fold, TAINTED)


#: Names that open a database or a network operation (fixed values).
DATABASE_CALLS = ("execute", "executemany", "fetchone", "fetchall", "query", "find_one", "aggregate")
NETWORK_CALLS = ("get", "post", "put", "patch", "delete", "request", "urlopen")
DATABASE_MODULES = ("sqlite3", "psycopg2", "pymongo", "sqlalchemy", "mysql", "asyncpg")
NETWORK_MODULES = ("requests", "httpx", "urllib", "aiohttp")


def provenance(imports: DataFrame, modules: tuple[str, ...], bindings: DataFrame, rounds: int | None = None) -> DataFrame:
    """(file_id, name): names of a file that come from one of the modules: the imports, and what is assigned from such names.

    bindings are (file_id, name, source) of assignments; names are followed until none is new, or through so many assignments at most.
    """
    first = F.substring_index("module", ".", 1)
    known = imports.where(first.isin(*modules)).select("file_id", first.alias("name"))
    return followed(known, bindings.select("file_id", "name", "source").distinct(), rounds)


def followed(known: DataFrame, bindings: DataFrame, rounds: int | None = None) -> DataFrame:
    """known (file_id, name, and what else is said of it) and the names that are assigned from such, of different bindings (file_id, name, source)."""
    from itertools import count

    from graphloom.operators.trace import _cut

    columns = known.columns
    known = front = _cut(known.distinct())
    bindings = _cut(bindings.where("name <> source").join(known.select("file_id").distinct(), "file_id", "left_semi"))
    for _ in count() if rounds is None else range(rounds):
        front = _cut(bindings.join(front.withColumnRenamed("name", "source"), ["file_id", "source"]).select(columns).distinct().join(known, columns, "left_anti"))
        if not front.limit(1).count():
            break
        known = _cut(known.unionByName(front))
    return known


def operations_in_loops(nodes: DataFrame, names: tuple[str, ...], origin: DataFrame, rule: str) -> DataFrame:
    """(file_id, start_line, name, rule_id, severity): calls of these names in loops.

    A call whose first name comes from a module of the kind is sure; others only have the name, and are information.
    """
    found = calls_in_loops(nodes, names)
    sure = origin.select("file_id", F.col("name").alias("_first"), F.lit(True).alias("_sure"))
    held = found.withColumn("_first", F.substring_index("name", ".", 1)).join(sure, ["file_id", "_first"], "left")
    strong = F.coalesce("_sure", F.lit(False))
    number = F.when(strong, F.lit(f"{rule}-001")).otherwise(F.lit(f"{rule}-002"))
    severity = F.when(strong, F.lit("error" if rule == "DB" else "warning")).otherwise(F.lit("info"))
    return held.select("file_id", "start_line", "name", number.alias("rule_id"), severity.alias("severity"))


def dynamic_execution(nodes: DataFrame) -> DataFrame:
    """(file_id, start_line, name): code run from anything but a literal."""
    calls = nodes.where("kind = 'call' AND name IN ('eval', 'exec', 'compile')")
    return calls.where(~F.col("text").rlike(r"^\w+\(\s*[rbuf]?[\"']")).select("file_id", "start_line", "name")


def unsafe_deserialization(nodes: DataFrame) -> DataFrame:
    """(file_id, start_line, name): loads that can build any object; yaml.load unless it says which safe loader it takes."""
    always = F.col("name").isin("pickle.load", "pickle.loads", "marshal.load", "marshal.loads", "dill.load", "dill.loads", "shelve.open")
    yaml = (F.col("name") == "yaml.load") & ~F.lower("text").contains("safeloader")
    return nodes.where((F.col("kind") == "call") & (always | yaml)).select("file_id", "start_line", "name")


#: Names that start all of a collection at once (fixed values).
PARALLEL = ("gather", "wait", "as_completed", "join_all")


def unbounded_parallel(nodes: DataFrame) -> DataFrame:
    """(file_id, start_line, name): everything of a collection started at once, without a bound."""
    calls = nodes.where((F.col("kind") == "call") & F.substring_index("name", ".", -1).isin(*PARALLEL) & F.col("holds_loop"))
    return calls.select("file_id", "start_line", "name")


#: Words that say that a route checks who asks (fixed values).
ACCESS_WORDS = ("auth", "login_required", "permission", "require_user", "current_user", "token")


def open_routes(symbols: DataFrame, calls: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, qualified, route_method): routes that change something and neither check access nor call what does."""
    named = calls.join(symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("caller")), "symbol_id").select("caller", "callee")
    checks = lambda c: F.lower(c).rlike("|".join(ACCESS_WORDS))
    marked = named.where(checks("callee")).select(F.col("callee").alias("name")).unionByName(symbols.where(checks("name")).select("name"))
    safe = reaching(named, marked, rounds)
    routes = symbols.where(F.col("route_path").isNotNull() & F.upper("route_method").isin("POST", "PUT", "PATCH", "DELETE"))
    return routes.join(safe, "name", "left_anti").select("id", "qualified", "route_method")
