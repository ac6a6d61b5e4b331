"""Rules as findings: one table of FINDINGS from syntax nodes, statements, symbols and lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import files as fx
from graphloom.operators import extraction, findings, intervals, summaries, syntax, taint
from graphloom.operators.trace import _cut
from graphloom.sources import python_ast

#: Complexity above which a function is reported (fixed value).
MAX_COMPLEXITY = 15


@dataclass(frozen=True)
class Rule:
    title: str
    severity: str
    confidence: str
    advice: str


RULES = {
    "ALG-001": Rule("Loop within a loop", "warning", "medium", "Check how far both inputs can grow; index one of them before."),
    "ALG-002": Rule("Linear search in a loop", "warning", "medium", "Put the collection into a map or set before the loop."),
    "ALG-003": Rule("Sort in a loop", "warning", "medium", "Sort once before the loop, or keep an ordered structure."),
    "DB-001": Rule("Database access in a loop", "error", "high", "Ask for all rows at once, by a join or a bulk operation."),
    "DB-002": Rule("Call in a loop that looks like database access", "info", "low", "Find out what the receiver is; batch the access if it is a database."),
    "DB-005": Rule("All columns are selected", "warning", "medium", "Name the columns that are used."),
    "NET-001": Rule("Request in a loop", "warning", "high", "Use a batch, or bounded concurrency with time limits."),
    "NET-002": Rule("Call in a loop that looks like a request", "info", "low", "Find out what the receiver is; batch or bound the calls if they leave the process."),
    "CON-001": Rule("Everything is started at once", "warning", "medium", "Bound the number of tasks that run at a time."),
    "CPLX-001": Rule("Function with many branches", "warning", "high", "Part the decisions that do not depend on each other."),
    "COV-001": Rule("Changed lines are not covered by tests", "warning", "high", "Test the changed lines, or report their coverage."),
    "SEC-001": Rule("Secret in a source", "error", "high", "Withdraw the secret and read it from where secrets are kept."),
    "SEC-002": Rule("Code from a value is run", "info", "low", "Make sure that nobody outside can choose the value."),
    "SEC-003": Rule("Unchecked value reaches a sensitive call", "info", "medium", "Check or restrict the value before the command, query or request."),
    "SEC-004": Rule("Weak digest or transport security", "warning", "high", "Use a current digest and protocol, and verify certificates."),
    "SEC-005": Rule("Loader that can build any object", "warning", "high", "Use a plain data format or the safe loader."),
    "SEC-006": Rule("Unchecked value becomes markup", "warning", "medium", "Escape the value for where it is shown."),
    "SEC-007": Rule("Unchecked value names a file", "info", "medium", "Resolve the path below an allowed folder."),
    "AUTH-001": Rule("Route that changes something without an access check", "info", "low", "Make sure that the route or what wraps it checks who asks."),
    "ERR-001": Rule("Error is dropped", "warning", "high", "Handle the error or let it pass on."),
    "DRY-001": Rule("Block of lines that another file has", "warning", "medium", "Keep the block in one place."),
    "DRY-002": Rule("Function that differs from another by names alone", "warning", "medium", "Keep one of them."),
    "DRY-003": Rule("Function that does what another does", "info", "low", "See whether one can serve both."),
    "ARCH-001": Rule("Large literal in code", "warning", "medium", "Keep the data in a file of its own."),
    "PARSE-001": Rule("Source cannot be parsed", "warning", "high", "Mend the source; only its secrets are looked for."),
}

#: Digests and protocols that are no longer safe, as what is called, stated or named.
_WEAK_DIGEST = r"(?i)(?:^|\.)(?:md5|sha1)$"
_WEAK_DIGEST_NAME = r"(?i)\b(?:new|createHash|getInstance)\(\s*[\"'](?:md5|sha-?1)[\"']"
_WEAK_TRANSPORT = r"(?i)\bverify\s*=\s*False\b|\bcheck_hostname\s*=\s*False\b|\bCERT_NONE\b|\bPROTOCOL_(?:SSLv[23]|TLSv1)\b|\b(?:SSLv3|TLSv1(?:\.0)?)\b[\"']?$"
_ALL_COLUMNS = r"(?i)\bselect\s+\*\s+from\b"

#: Names of files are broadcast up to so many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000

#: What rules find: a file, its lines, and what shows it.
FOUND = ("file_id", "rule_id", "line", "end_line", "evidence")


#: Columns of nodes that the rules on single nodes read, and the kinds that each rule looks at.
NODE_COLUMNS = ("kind", "name", "start_line", "end_line", "size", "text", "depth", "parent_kind", "bounded", "holds_loop")
NODE_KINDS = {"ALG-001": ("loop",), "SEC-004": ("call", "keyword", "assign"), "ERR-001": ("handler",), "ARCH-001": ("literal",), "PARSE-001": ("error",)}


def node_kinds(*rules: str) -> tuple[str, ...]:
    """The kinds of nodes that these rules look at; most look at calls."""
    return tuple(dict.fromkeys(k for r in rules for k in NODE_KINDS.get(r, ("call",))))


def node_findings(nodes: DataFrame, origin: DataFrame | None = None, local: DataFrame | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """FOUND by the rules that look at one node (or by some of them only): one pass over the nodes, each gives the rules that it breaks.

    origin (file_id, name, classes) are names that come from modules of databases or networks, local (file_id, function,
    classes) functions of the file that reach such; classes are bits of ``taint``. Calls by these are sure.
    """
    c = F.col
    held = nodes.withColumn("_first", F.substring_index("name", ".", 1))
    nothing = F.lit(0)
    for known, key, name in ((origin, "name", "_origin"), (local, "function", "_local")):
        if known is None:
            held = held.withColumn(name, nothing)
        else:
            k = _cut(known.groupBy("file_id", c(key).alias("_first")).agg(F.bit_or("classes").alias(name)))
            few = k.count() <= BROADCAST_ROWS  # then the nodes, with their texts, stay where they are
            held = held.join(F.broadcast(k) if few else k, ["file_id", "_first"], "left")
    method = F.substring_index("name", ".", -1)
    sure = F.coalesce("_origin", nothing).bitwiseOR(F.when(~c("name").contains("."), F.coalesce("_local", nothing)).otherwise(nothing))
    call, loop = c("kind") == "call", c("depth") > 0
    queries, requests = sure.bitwiseAND(F.lit(taint.QUERY)) > 0, sure.bitwiseAND(F.lit(taint.NETWORK)) > 0
    # a name that comes from a module counts where its method is one of the kind
    operation = lambda names: ~c("name").contains(".") | method.isin(*names)
    db = queries & operation((*syntax.DATABASE_CALLS, *taint.DATABASE_METHODS))
    net = requests & operation((*syntax.NETWORK_CALLS, *taint.NETWORK_METHODS))
    always = c("name").isin("pickle.load", "pickle.loads", "marshal.load", "marshal.loads", "dill.load", "dill.loads", "shelve.open")
    yaml = (c("name") == "yaml.load") & ~F.lower("text").contains("safeloader")
    weak = (call & (c("name").rlike(_WEAK_DIGEST) | c("text").rlike(_WEAK_DIGEST_NAME))) | (c("kind").isin("keyword", "assign") & c("text").rlike(_WEAK_TRANSPORT))
    large = (c("end_line") - c("start_line") + 1 >= 80) | (c("size") >= 50)
    broken: dict[str, Column] = {
        "ALG-001": (c("kind") == "loop") & loop & ~c("bounded"),
        "ALG-002": call & loop & method.isin(*syntax.LOOKUPS),
        "ALG-003": call & loop & method.isin(*syntax.SORTS),
        "DB-001": call & loop & db,
        "DB-002": call & loop & ~db & taint.is_database(c("name")),
        "NET-001": call & loop & net,
        "NET-002": call & loop & ~net & taint.is_network(c("name")),
        "CON-001": call & method.isin(*syntax.PARALLEL) & c("holds_loop"),
        "DB-005": call & (taint.is_database(c("name")) | db) & c("text").rlike(_ALL_COLUMNS),
        "SEC-004": weak,
        "SEC-005": call & (always | yaml),
        "ERR-001": (c("kind") == "handler") & (c("name") == "empty"),
        "ARCH-001": (c("kind") == "literal") & large & ~c("parent_kind").eqNullSafe("literal"),
        "PARSE-001": c("kind") == "error",
    }
    rules = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(rule)) for rule, x in broken.items() if only is None or rule in only]))
    evidence = F.when(c("text") != "", c("text")).when(c("kind") == "error", c("name")).otherwise(F.concat_ws(" ", "kind", F.nullif(c("name"), F.lit(""))))
    return held.select("file_id", F.explode(rules).alias("rule_id"), c("start_line").alias("line"), "end_line", evidence.alias("evidence"))


def complexity_findings(nodes: DataFrame, most: int = MAX_COMPLEXITY) -> DataFrame:
    """FOUND for functions of a higher complexity."""
    found = syntax.complexity(nodes).where(F.col("complexity") > most)
    evidence = F.format_string("%s: complexity %d exceeds %d", "name", "complexity", F.lit(most))
    return found.select("file_id", F.lit("CPLX-001").alias("rule_id"), F.col("start_line").alias("line"), "end_line", evidence.alias("evidence"))


def taint_findings(statements: DataFrame | None = None, sanitizers: tuple[str, ...] = (), sources: DataFrame | None = None) -> DataFrame:
    """FOUND for unchecked values at sinks, in statements or in sources (file_id, text); where code is run from a value that is none of them, that is reported instead."""
    held = summaries.Summaries(statements, sanitizers, sources)
    reached = _cut(held.tainted())
    rule = F.when(F.col("class") == taint.HTML, "SEC-006").when(F.col("class") == taint.PATH, "SEC-007").otherwise("SEC-003")
    bad = reached.select("file_id", rule.alias("rule_id"), "line", "end_line", "evidence")
    run = held.runs.select("file_id", F.lit("SEC-002").alias("rule_id"), "line", "end_line", "evidence")
    return bad.unionByName(run.join(reached.select("file_id", "line", "evidence"), ["file_id", "line", "evidence"], "left_anti"))


def origins(imports: DataFrame, statements: DataFrame) -> DataFrame:
    """(file_id, name, classes): names that come from modules of databases or networks, by imports (file_id, module) and assignments."""
    uses = statements.where("kind = 'assign'").select("file_id", F.col("target").alias("name"), F.explode("uses").alias("use"))
    made = uses.select("file_id", "name", F.substring_index("use", ".", 1).alias("source")).distinct()
    first = F.substring_index("module", ".", 1)
    bits = F.when(first.isin(*syntax.DATABASE_MODULES), taint.QUERY).when(first.isin(*syntax.NETWORK_MODULES), taint.NETWORK)
    return syntax.followed(imports.select("file_id", first.alias("name"), bits.alias("classes")).where("classes IS NOT NULL"), made)


def route_findings(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """FOUND for routes that change something and check no access."""
    open_ = syntax.open_routes(symbols, calls).select("id")
    evidence = F.concat_ws(" ", "route_method", "route_path")
    return symbols.join(open_, "id", "left_semi").select("file_id", F.lit("AUTH-001").alias("rule_id"), F.col("start_line").alias("line"), "end_line", evidence.alias("evidence"))


def duplicate_findings(functions: DataFrame) -> DataFrame:
    """FOUND for functions that differ from an earlier one by names alone, or do what it does."""
    lines = functions.select("file_id", "name", F.col("start_line").alias("line"), "end_line")
    renamed = syntax.renamed_duplicates(functions).select("file_id", "name", F.lit("DRY-002").alias("rule_id"), F.col("first_name").alias("evidence"))
    alike = syntax.behavioural_duplicates(functions).select("file_id", "name", F.lit("DRY-003").alias("rule_id"), F.col("first_name").alias("evidence")).distinct()
    return renamed.unionByName(alike).join(lines, ["file_id", "name"]).select(*FOUND)


def line_findings(lines: DataFrame) -> DataFrame:
    """(path, rule_id, line, end_line, evidence) for secrets, and for blocks of lines that an earlier file has, of lines (path, ln, line)."""
    end = F.lit(None).cast("long").alias("end_line")
    secrets = findings.secret_lines(lines).select("path", "rule_id", "line", end, "evidence")
    pairs = findings.duplicate_pairs(findings.duplicate_blocks(lines))
    block = F.format_string("block at %s:%d", "first_path", "first_line")
    return secrets.unionByName(pairs.select("path", F.lit("DRY-001").alias("rule_id"), "line", end, block.alias("evidence")))


def coverage_findings(hits: DataFrame | None, changed: DataFrame, least: int = 80, report: str = "coverage") -> DataFrame:
    """(path, rule_id, line, end_line, evidence): a row if too few of the changed lines that can be covered are, or if there is no report (hits is None).

    Only changes of files that can be covered count: without one, there is no row. Percent are whole, rounded down.
    """
    coverable = changed.where(F.coalesce(fx.is_coverable(F.col("path")), F.lit(False)))
    none = F.lit(None).cast("long")
    row = [F.lit(report).alias("path"), F.lit("COV-001").alias("rule_id"), none.alias("line"), none.alias("end_line")]
    if hits is None:
        return coverable.limit(1).select(*row, F.lit("no coverage report").alias("evidence"))
    made = findings.changed_coverage(hits, coverable).where((F.col("coverable") > 0) & (F.col("percent") < least))
    return made.select(*row, F.format_string("%d%% of changed lines, below %d%%", "percent", F.lit(least)).alias("evidence"))


def syntax_findings(parsed: DataFrame, sanitizers: tuple[str, ...] = ()) -> DataFrame:
    """FOUND by all rules on syntax and dataflow, for parsed(): what was parsed is written once and read by each of them."""
    held = _cut(parsed)
    nodes, statements = _cut(python_ast.nodes(held)), _cut(python_ast.statements(held))
    imports = nodes.where("kind = 'import'").select("file_id", F.col("name").alias("module")).distinct()
    graph = extraction.tables(nodes)
    made = node_findings(nodes, origins(imports, statements), summaries.sink_classes(statements))
    for more in (complexity_findings(nodes), taint_findings(statements, sanitizers), route_findings(_cut(graph["symbols"]), graph["calls"]), duplicate_findings(_cut(extraction.functions(nodes)))):
        made = made.unionByName(more)
    return made


def all_findings(sources: DataFrame, changed: DataFrame | None = None, hits: DataFrame | None = None, sanitizers: tuple[str, ...] = (), mode: str = "standard") -> DataFrame:
    """FINDINGS of all rules for sources (file_id, path, text), each parsed once; with changed lines, of their coverage as well. One of each rule, path and line."""
    paths = sources.select("file_id", "path")
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("_n", "line")).select("path", (F.col("_n") + 1).cast("long").alias("ln"), "line")
    by_path = line_findings(lines)
    if changed is not None:
        by_path = by_path.unionByName(coverage_findings(hits, changed))
    by_file = syntax_findings(python_ast.parsed(sources), sanitizers).join(paths, "file_id").select("path", "rule_id", "line", "end_line", "evidence")
    return deduplicated(with_rules(by_file.unionByName(by_path), mode))


def as_findings(found: DataFrame, paths: DataFrame, mode: str = "standard") -> DataFrame:
    """FINDINGS of FOUND, with the paths of files (file_id, path)."""
    return with_rules(found.join(paths.select("file_id", "path"), "file_id"), mode)


def with_rules(found: DataFrame, mode: str = "standard") -> DataFrame:
    """FINDINGS of (path, rule_id, line, end_line, evidence); the table of rules is short."""
    rows = [(k, r.title, r.severity, r.confidence, r.advice) for k, r in RULES.items()]
    rules = found.sparkSession.createDataFrame(rows, "rule_id string, title string, severity string, confidence string, recommendation string")
    held = found.join(F.broadcast(rules), "rule_id")
    return held.select(
        "rule_id", "title", "severity", "confidence", findings.blocks(F.col("severity"), mode).alias("blocking"), "path", F.col("line").cast("long").alias("line"),
        F.col("end_line").cast("long").alias("end_line"), "evidence", "recommendation",
    )


def deduplicated(found: DataFrame) -> DataFrame:
    """Findings with one of each rule, path and line: that with the smallest evidence."""
    order = Window.partitionBy("rule_id", "path", "line").orderBy("evidence", "end_line")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def in_scope(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings that touch changed lines (path, start, end); one without an end is of its line alone."""
    held = found.withColumn("_end", F.coalesce("end_line", "line"))
    spans = changed.select("path", F.col("start").alias("_from"), F.col("end").alias("_to"))
    return intervals.touching(held, spans, ["path"], ("line", "_end"), ("_from", "_to")).select(*found.columns)


def sarif_documents(found: DataFrame, tool: str = "graphloom") -> DataFrame:
    """(path, json): a SARIF 2.1.0 document for each path, with its rules and results in order. A document is of one file, so it stays small."""
    c = F.col
    level = F.when(c("severity") == "info", "note").otherwise(c("severity"))
    region = F.struct(c("line").alias("startLine"), F.coalesce("end_line", "line").alias("endLine"))
    place = F.struct(F.struct(F.struct(c("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(c("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(": ", "title", "evidence").alias("text")).alias("message"), F.array(place).alias("locations"))
    rule = F.struct(c("rule_id").alias("id"), F.struct(c("title").alias("text")).alias("shortDescription"), F.struct(c("recommendation").alias("text")).alias("help"))
    made = found.groupBy("path").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(c("line"), c("rule_id"), c("evidence"), result.alias("r")))), lambda x: x["r"]).alias("results"), F.sort_array(F.collect_set(rule)).alias("rules")
    )
    driver = F.struct(F.struct(F.lit(tool).alias("name"), c("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), c("results"))
    return made.select("path", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))
