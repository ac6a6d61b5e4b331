"""The repository queries on the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import catalogue_rules
from graphloom.functions import files as fx
from graphloom.functions import text as tx
from graphloom.operators import evaluation, extraction, findings, graph, impact, index, payloads, search, sessions, syntax, trace, trees
from graphloom.operators.trace import _cut
from graphloom.sources import python_ast, store
from graphloom.registering import oracle_sql, queries, query
from graphloom.sources.adapter import Graph, python_sources
from graphloom.streaming import session as session_stream

__all__ = ["catalogue_rules", "flagship", "oracle_sql", "queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_pattern(Graph(spark, sf_dir))


# --- lookups and patterns -------------------------------------------------------------------------------------------

_FIND = "SELECT id, qualified, path, start_line FROM symbol_rows"


@query("find_exact", f"{_FIND} WHERE qualified = 'small ring' OR name = 'small ring'", "symbol_rows")
def find_exact(g: Graph) -> DataFrame:
    return graph.find_symbols(g.symbol_rows, "small ring").select("id", "qualified", "path", "start_line")


@query("find_fallback", f"{_FIND} WHERE lower(qualified) LIKE '%.small%' AND NOT EXISTS (SELECT 1 FROM symbol_rows WHERE qualified = '.SMALL' OR name = '.SMALL')", "symbol_rows")
def find_fallback(g: Graph) -> DataFrame:
    return graph.find_symbols(g.symbol_rows, ".SMALL").select("id", "qualified", "path", "start_line")


@query("match_wildcard", f"{_FIND} WHERE lower(qualified) LIKE 'brand#1_.%ring' AND kind = 'function'", "symbol_rows")
def match_wildcard(g: Graph) -> DataFrame:
    return graph.match_symbols(g.symbol_rows, "Brand#1?.*ring", "function").select("id", "qualified", "path", "start_line")


@query("node_pattern", "SELECT qualified, path, CAST(start_line AS VARCHAR) AS line, CASE WHEN exported THEN 'true' ELSE 'false' END AS exported FROM symbol_rows WHERE kind = 'function' AND lower(name) = 'small ring'", "symbol_rows")
def node_pattern(g: Graph) -> DataFrame:
    return graph.match_nodes(g.symbol_rows, g.files, "Function", {"name": "SMALL Ring"}, ("qualified", "path", "line", "exported"))


@query("node_glob", "SELECT qualified, coalesce(route_path, '') AS route_path FROM symbol_rows WHERE route_path IS NOT NULL AND lower(path) LIKE 'nation_1_/%' AND lower(name) LIKE '%ring'", "symbol_rows")
def node_glob(g: Graph) -> DataFrame:
    return graph.match_nodes(g.symbol_rows, g.files, "Route", {"path": "nation_1?/*", "name": "*ring"}, ("qualified", "route_path"))


@query("node_limit", "SELECT qualified, path FROM symbol_rows WHERE kind = 'type' ORDER BY path, start_line, id LIMIT 25", "symbol_rows")
def node_limit(g: Graph) -> DataFrame:
    return graph.match_nodes(g.symbol_rows, g.files, "Type", None, ("qualified", "path"), 25)


@query("calls_pattern", "SELECT DISTINCT a.id AS a_id, a.name AS a_name, b.id AS b_id, b.qualified AS b_qualified FROM symbols a JOIN calls c ON c.symbol_id = a.id JOIN symbols b ON b.name = c.callee AND (c.receiver IS NULL OR b.container = c.receiver) WHERE a.kind = 'function' AND b.kind = 'function' AND a.name = 'small ring'", "symbols", "calls")
def calls_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "Function", "CALLS", "Function", ({"name": "small ring"}, {}), ("a.id", "a.name", "b.id", "b.qualified"))


@query("called_by_pattern", "SELECT a.id AS a_id, b.id AS b_id, b.path AS b_path FROM symbols a JOIN calls c ON c.callee = a.name AND (c.receiver IS NULL OR c.receiver = a.container) JOIN symbol_rows b ON b.id = c.symbol_id WHERE a.kind = 'method' AND b.kind = 'module' AND a.qualified = 'Brand#1.small ring' GROUP BY ALL", "symbol_rows", "calls")
def called_by_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "Method", "CALLED_BY", "Module", ({"qualified": "Brand#1.small ring"}, {}), ("a.id", "b.id", "b.path"))


@query("extends_pattern", "WITH firsts AS (SELECT e.name, s.id, row_number() OVER (PARTITION BY e.name ORDER BY s.path, s.start_line, s.id) AS rn FROM (SELECT DISTINCT name FROM extends) e JOIN symbol_rows s ON s.name = e.name) SELECT a.id AS a_id, b.id AS b_id, b.qualified AS b_qualified FROM symbols a JOIN extends e ON e.symbol_id = a.id JOIN firsts f ON f.name = e.name AND rn <= 8 JOIN symbols b ON b.id = f.id WHERE a.kind = 'type' AND b.kind = 'type'", "symbol_rows", "extends")
def extends_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "Type", "EXTENDS", "Type", ({}, {}), ("a.id", "b.id", "b.qualified"))


@query("implemented_by_pattern", "SELECT a.id AS a_id, b.id AS b_id FROM symbols a JOIN extends e ON e.name = a.name JOIN symbols b ON b.id = e.symbol_id WHERE a.kind = 'module' AND b.kind = 'type' AND a.name = 'small ring'", "symbols", "extends")
def implemented_by_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "Module", "IMPLEMENTED_BY", "Type", ({"name": "small ring"}, {}), ("a.id", "b.id"))


@query("contains_pattern", "SELECT f.path AS a_path, s.qualified AS b_qualified, CAST(s.start_line AS VARCHAR) AS b_line FROM files f JOIN symbols s ON s.file_id = f.id WHERE s.kind = 'method'", "files", "symbols")
def contains_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "File", "CONTAINS", "Method", ({}, {}), ("a.path", "b.qualified", "b.line"))


@query("imports_pattern", "SELECT a.path AS a_path, b.path AS b_path FROM files a JOIN imports i ON i.file_id = a.id JOIN files b ON b.stem = i.stem AND b.id <> a.id", "files", "imports")
def imports_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "File", "IMPORTS", "File", ({}, {}), ("a.path", "b.path"))


_URL = "string_split(regexp_replace(string_split(CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(url, '^.*?://', ''), '^[^/]*/?', '') ELSE url END, '?')[1], '^/+|/+$', '', 'g'), '/')"
_ROUTE = "string_split(regexp_replace(route_path, '^/+|/+$', '', 'g'), '/')"


@query("service_edges", f"WITH l AS (SELECT DISTINCT symbol_id, method, url, {_URL} AS u FROM service_links), r AS (SELECT *, {_ROUTE} AS s FROM routes), m AS (SELECT l.symbol_id, l.method, l.url, min(struct_pack(a := route_path, b := path, c := qualified)).c AS route FROM l JOIN r ON len(u) = len(s) AND (l.method IS NULL OR r.route_method IS NULL OR lower(l.method) = lower(r.route_method)) WHERE len(list_filter(range(1, len(u)+1), lambda i: NOT (regexp_matches(s[i], '^(:.*|\\{{.*\\}}|<.*>|\\*.*)$') OR lower(s[i]) = lower(u[i])))) = 0 GROUP BY ALL) SELECT s.symbol_id, s.method, s.url, m.route FROM service_links s LEFT JOIN m ON s.symbol_id = m.symbol_id AND s.method IS NOT DISTINCT FROM m.method AND s.url = m.url", "service_links", "routes")
def service_edges(g: Graph) -> DataFrame:
    return graph.service_edges(g.service_links, g.routes)


@query("callers_of_name", "SELECT s.id, c.symbol_id AS caller_id, count(*) AS n FROM symbols s JOIN calls c ON c.callee = s.name AND (c.receiver IS NULL OR c.receiver = s.container) WHERE s.name = 'red widget' GROUP BY ALL", "symbols", "calls")
def callers_of_name(g: Graph) -> DataFrame:
    return graph.callers(g.calls, graph.find_symbols(g.symbols, "red widget"))


@query("callees_of_name", "SELECT DISTINCT c.symbol_id, t.id FROM symbols s JOIN calls c ON c.symbol_id = s.id JOIN symbols t ON t.name = c.callee AND (c.receiver IS NULL OR t.container = c.receiver) WHERE s.name = 'red widget'", "symbols", "calls")
def callees_of_name(g: Graph) -> DataFrame:
    own = graph.find_symbols(g.symbols, "red widget").select(F.col("id").alias("symbol_id"))
    return graph.callees(g.calls.join(own, "symbol_id", "left_semi"), g.symbols)


@query("dependents", "SELECT DISTINCT b.path AS path, a.path AS dependent FROM files a JOIN imports i ON i.file_id = a.id JOIN files b ON b.stem = i.stem AND b.id <> a.id", "files", "imports")
def dependents(g: Graph) -> DataFrame:
    held = graph.dependents(g.imports, g.files)
    a = g.files.select("id", "path")
    return held.join(a, "id").join(g.files.select(F.col("id").alias("dependent_id"), F.col("path").alias("dependent")), "dependent_id").select("path", "dependent")


@query("external_deps", "SELECT stem AS module, count(*) AS uses FROM imports WHERE stem NOT IN (SELECT stem FROM files) GROUP BY 1", "files", "imports")
def external_deps(g: Graph) -> DataFrame:
    return graph.external_dependencies(g.imports, g.files)


@query("unresolved_calls", "SELECT path, callee, qualifier, line, \"character\", length(qualifier) AS width FROM calls c JOIN symbol_rows s ON s.id = c.symbol_id WHERE receiver IS NULL AND qualifier IS NOT NULL AND line > 0", "calls", "symbol_rows")
def unresolved_calls(g: Graph) -> DataFrame:
    return graph.unresolved_calls(g.calls, g.symbol_rows)


@query("fan_in_out", "SELECT s.id, (SELECT count(*) FROM calls c WHERE c.callee = s.name AND (s.container IS NULL OR c.receiver IS NULL OR c.receiver = s.container)) AS fan_in, (SELECT count(*) FROM calls c WHERE c.symbol_id = s.id) AS fan_out FROM symbols s", "symbols", "calls")
def fan_in_out(g: Graph) -> DataFrame:
    return graph.fan_counts(g.calls, g.symbols)


@query("distinct_callers", "SELECT callee AS name, count(DISTINCT symbol_id) AS callers FROM calls GROUP BY 1", "calls")
def distinct_callers(g: Graph) -> DataFrame:
    return g.calls.groupBy(F.col("callee").alias("name")).agg(F.countDistinct("symbol_id").alias("callers"))


# --- summaries ------------------------------------------------------------------------------------------------------


@query("totals", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE is_test) AS test_files, (SELECT count(*) FROM symbols) AS symbols", "files", "symbols")
def totals(g: Graph) -> DataFrame:
    return impact.totals(g.files, g.symbols)


@query("language_counts", "SELECT language, count(*) AS files FROM files GROUP BY 1", "files")
def language_counts(g: Graph) -> DataFrame:
    return g.files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query("modules", "SELECT module, count(*) AS files, array_to_string(list_sort(list(path) FILTER (rn <= 20)), ',') AS first_paths FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS module, path, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path) AS rn FROM files) GROUP BY 1", "files")
def modules(g: Graph) -> DataFrame:
    return impact.modules(g.files)


_LAYER_SQL = "CASE " + " ".join("WHEN list_has_any(w, [" + ", ".join(f"'{k}{s}'" for k in keys for s in ("", "s")) + f"]) THEN '{name}'" for name, keys in fx.LAYERS) + " END"


@query("layers", f"SELECT layer, count(*) AS files FROM (SELECT {_LAYER_SQL} AS layer FROM (SELECT list_filter(string_split_regex(lower(p), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (SELECT event_type || '/' || CASE user_id % 7 WHEN 0 THEN 'routes' WHEN 1 THEN 'order_service' WHEN 2 THEN 'guard' WHEN 3 THEN 'settings' WHEN 4 THEN 'report' WHEN 5 THEN 'dao' ELSE 'cmd' END AS p FROM events))) WHERE layer IS NOT NULL GROUP BY 1")
def layers(g: Graph) -> DataFrame:
    names = ["routes", "order_service", "guard", "settings", "report", "dao", "cmd"]
    folder = F.get(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 7).cast("int"))
    return impact.layers(g.table("events").select(F.concat("event_type", F.lit("/"), folder).alias("path")))


@query("entry_points", "SELECT qualified, path, start_line FROM symbol_rows WHERE (name IN ('main','handler','lambda_handler','run','serve') AND container IS NULL) OR route_path IS NOT NULL", "symbol_rows")
def entry_points(g: Graph) -> DataFrame:
    return impact.entry_points(g.symbol_rows)


@query("symbol_cards", "SELECT s.id, s.qualified, s.kind, s.path, s.start_line, s.end_line, s.signature, (SELECT count(*) FROM calls c WHERE c.callee = s.name AND (c.receiver IS NULL OR c.receiver = s.container)) AS fan_in, (SELECT count(*) FROM calls c WHERE c.symbol_id = s.id) AS fan_out, coalesce(n.callees, '') AS callees FROM symbol_rows s LEFT JOIN (SELECT symbol_id, array_to_string(list_sort(list(callee)), ',') AS callees FROM (SELECT symbol_id, callee, row_number() OVER (PARTITION BY symbol_id ORDER BY callee) AS rn FROM (SELECT DISTINCT symbol_id, callee FROM calls)) WHERE rn <= 20 GROUP BY 1) n ON n.symbol_id = s.id", "symbol_rows", "calls")
def symbol_cards(g: Graph) -> DataFrame:
    return impact.cards(g)


@query("snippet_budget", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN strlen(p) > 400 THEN NULL ELSE p END AS snippet, strlen(p) > 400 AS withheld FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS p FROM documents)")
def snippet_budget(g: Graph) -> DataFrame:
    return impact.snippets(g.table("documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 2, 4, 400)


# --- search ---------------------------------------------------------------------------------------------------------

_RUN = "list_concat(string_split(regexp_replace(regexp_replace(r, '(\\P{Lu})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), ' '), CASE WHEN len(string_split(regexp_replace(regexp_replace(r, '(\\P{Lu})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), ' ')) > 1 THEN [r] ELSE [] END)"
_TOKENS = "list_transform(flatten(list_transform(list_filter(string_split_regex({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda r: r <> ''), lambda r: " + _RUN.replace("{", "{{").replace("}", "}}") + ")), lambda w: lower(w))"
_DOCS = "WITH d AS (SELECT id, path, start_line, qualified, " + _TOKENS.format("concat_ws(' ', qualified, signature, path)") + " AS tokens FROM symbol_rows)"


@query("tokenize", "SELECT c_custkey AS id, array_to_string(" + _TOKENS.format("c_name || 'HTTPServer' || lower(c_mktsegment) || 'Pool_' || c_mktsegment") + ", ' ') AS tokens FROM customer")
def tokenize(g: Graph) -> DataFrame:
    name = F.concat("c_name", F.lit("HTTPServer"), F.lower("c_mktsegment"), F.lit("Pool_"), "c_mktsegment")
    return g.table("customer").select(F.col("c_custkey").alias("id"), F.array_join(tx.tokenize(name), " ").alias("tokens"))


@query("idf_table", f"{_DOCS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(tokens) AS term FROM d) GROUP BY 1), (SELECT count(*) AS n FROM d)", "symbol_rows")
def idf_table(g: Graph) -> DataFrame:
    return search.idf(search.documents(g.symbol_rows)).withColumn("idf", F.round("idf", 6))


@query("bm25_topk", f"{_DOCS}, s AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d), q AS (SELECT unnest(['small', 'ring', 'nation']) AS t), f AS (SELECT t, count(*) FILTER (list_contains(tokens, t)) AS df FROM q, d GROUP BY 1), x AS (SELECT id, d.qualified, d.path, d.start_line, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))) AS score FROM (SELECT d.*, t, len(list_filter(tokens, lambda y: y = t)) AS tf FROM d, q) d JOIN f USING (t), s GROUP BY ALL) SELECT id, qualified, path, start_line, round(score, 6) AS score FROM x WHERE score > 0 ORDER BY round(score, 9) DESC, path, start_line, id LIMIT 50", "symbol_rows")
def bm25_topk(g: Graph) -> DataFrame:
    return search.bm25(search.documents(g.symbol_rows), "small ring nation", 50).withColumn("score", F.round("score", 6))


# --- call chains and impact -----------------------------------------------------------------------------------------


def _trace_sql(direction: str, depth: int) -> str:
    """Levels of the walk, written out: each takes the edges of the last level's symbols and leaves out those reached before."""
    ways = []
    if direction in ("inbound", "both"):
        ways.append("SELECT DISTINCT s.id, c.symbol_id AS \"to\", 'inbound' AS way FROM symbols s JOIN calls c ON c.callee = s.name AND (c.receiver IS NULL OR c.receiver = s.container)")
    if direction in ("outbound", "both"):
        ways.append("SELECT DISTINCT c.symbol_id AS id, t.id AS \"to\", 'outbound' AS way FROM calls c JOIN symbols t ON t.name = c.callee AND (c.receiver IS NULL OR t.container = c.receiver)")
    ctes = [f"edges AS MATERIALIZED ({' UNION ALL '.join(ways)})", f"l0 AS MATERIALIZED (SELECT id, qualified, 0 AS depth, '{direction}' AS direction, '' AS via, 0 AS seq FROM symbol_rows WHERE name = 'small ring' ORDER BY path, start_line, id LIMIT 1)"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(k))
        ctes.append(
            f"l{k} AS MATERIALIZED (SELECT id, qualified, {k} AS depth, way AS direction, via, row_number() OVER (ORDER BY seq, way, path, start_line, id) - 1 AS seq FROM "
            f"(SELECT e.\"to\" AS id, b.qualified, b.path, b.start_line, e.way, l.qualified AS via, l.seq, row_number() OVER (PARTITION BY e.\"to\" ORDER BY l.seq, e.way, l.qualified) AS rn FROM l{k - 1} l JOIN edges e ON e.id = l.id AND (l.direction = 'both' OR l.direction = e.way) "
            f"JOIN symbol_rows b ON b.id = e.\"to\" WHERE e.\"to\" NOT IN ({before})) WHERE rn = 1)"
        )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT id, qualified, CAST(depth AS BIGINT) AS depth, direction, via FROM l{k}" for k in range(1, depth + 1))


@query("trace_inbound", _trace_sql("inbound", 2), "symbol_rows", "calls")
def trace_inbound(g: Graph) -> DataFrame:
    return trace.trace(g.calls, g.symbol_rows, "small ring", "inbound", 2)


@query("trace_outbound", _trace_sql("outbound", 2), "symbol_rows", "calls")
def trace_outbound(g: Graph) -> DataFrame:
    return trace.trace(g.calls, g.symbol_rows, "small ring", "outbound", 2)


@query("trace_both", _trace_sql("both", 2), "symbol_rows", "calls")
def trace_both(g: Graph) -> DataFrame:
    return trace.trace(g.calls, g.symbol_rows, "small ring", "both", 2)


_IMPACT = (
    "WITH hit AS (SELECT s.* FROM symbol_rows s WHERE EXISTS (SELECT 1 FROM changed_lines c WHERE c.path = s.path AND s.start_line <= c.\"end\" AND s.end_line >= c.\"start\")), "
    "site AS (SELECT h.id, c.symbol_id AS caller_id FROM hit h JOIN calls c ON c.callee = h.name AND (c.receiver IS NULL OR c.receiver = h.container)), "
    "agg AS (SELECT site.id, count(*) AS callers, count(DISTINCT b.path) AS caller_files, count(DISTINCT CASE WHEN b.is_test THEN b.path END) AS tests FROM site JOIN symbol_rows b ON b.id = site.caller_id GROUP BY 1), "
    "base AS (SELECT h.*, coalesce(callers, 0) AS callers, coalesce(caller_files, 0) AS caller_files, coalesce(tests, 0) AS tests FROM hit h LEFT JOIN agg USING (id)), "
    "scored AS (SELECT *, (CASE WHEN callers >= 10 THEN 2 WHEN callers >= 3 THEN 1 ELSE 0 END) + (CASE WHEN route_path IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN exported AND NOT is_test THEN 1 ELSE 0 END) + (CASE WHEN tests = 0 AND NOT is_test THEN 1 ELSE 0 END) AS score FROM base), "
    "out AS (SELECT id, qualified, path, callers, caller_files, tests, CAST(score AS BIGINT) AS score, CASE WHEN score <= 1 THEN 'low' WHEN score <= 3 THEN 'medium' ELSE 'high' END AS level FROM scored) "
)


@query("impact_symbols", _IMPACT + "SELECT * FROM out", "symbol_rows", "calls", "changed_lines")
def impact_symbols(g: Graph) -> DataFrame:
    return impact.impact(g, g.changed_lines)


@query("impact_summary", _IMPACT + "SELECT count(*) AS symbols, count(*) FILTER (tests = 0) AS untested, sum(callers) AS callers, count(DISTINCT path) AS files, max(score) AS top_score, count(*) FILTER (level = 'high') AS high FROM out", "symbol_rows", "calls", "changed_lines")
def impact_summary(g: Graph) -> DataFrame:
    return impact.impact_summary(impact.impact(g, g.changed_lines))


@query("risk_levels", _IMPACT + "SELECT level, count(*) AS symbols FROM out GROUP BY 1", "symbol_rows", "calls", "changed_lines")
def risk_levels(g: Graph) -> DataFrame:
    return impact.impact(g, g.changed_lines).groupBy("level").agg(F.count(F.lit(1)).alias("symbols"))


@query(
    "impact_reasons",
    _IMPACT + "SELECT o.id, o.score, list_filter([CASE WHEN o.callers >= 3 THEN o.callers || ' call sites' END, CASE WHEN s.route_path IS NOT NULL THEN 'handles ' || s.route_path END, CASE WHEN s.exported AND NOT s.is_test THEN 'exported' END, "
    "CASE WHEN o.tests = 0 AND NOT s.is_test THEN 'no test calls it' END], lambda x: x IS NOT NULL) AS reasons FROM out o JOIN symbol_rows s ON s.id = o.id",
    "symbol_rows",
    "calls",
    "changed_lines",
)
def impact_reasons(g: Graph) -> DataFrame:
    return impact.reasons(impact.impact(g, g.changed_lines), g.symbol_rows)


@query(
    "blast_radius",
    'WITH hit AS (SELECT s.* FROM symbol_rows s WHERE EXISTS (SELECT 1 FROM changed_lines c WHERE c.path = s.path AND s.start_line <= c."end" AND s.end_line >= c."start")), '
    "near AS (SELECT b.* FROM symbol_rows b WHERE b.id IN (SELECT c.symbol_id FROM hit h JOIN calls c ON c.callee = h.name AND (c.receiver IS NULL OR c.receiver = h.container))) "
    "SELECT DISTINCT 'symbol' AS kind, qualified AS name FROM hit UNION ALL SELECT DISTINCT 'caller', qualified FROM near UNION ALL SELECT DISTINCT 'test', path FROM near WHERE is_test "
    "UNION ALL SELECT DISTINCT 'route', route_path FROM (SELECT route_path FROM hit UNION ALL SELECT route_path FROM near) WHERE route_path IS NOT NULL",
    "symbol_rows",
    "calls",
    "changed_lines",
)
def blast_radius(g: Graph) -> DataFrame:
    return impact.blast_radius(g, g.changed_lines)


@query(
    "ranked_callees",
    "WITH n AS (SELECT s.kind, c.callee, count(*) AS uses FROM calls c JOIN symbols s ON s.id = c.symbol_id GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY uses DESC, callee) AS place, count(*) OVER (PARTITION BY kind) > 20 AS truncated FROM n) WHERE place <= 20",
    "symbols",
    "calls",
)
def ranked_callees(g: Graph) -> DataFrame:
    """The functions that symbols of each kind call most, and whether there are more."""
    held = g.calls.join(g.symbols.select(F.col("id").alias("symbol_id"), "kind"), "symbol_id").groupBy("kind", "callee").agg(F.count(F.lit(1)).alias("uses"))
    return impact.ranked(held, "kind", "uses", "callee").withColumn("place", F.col("place").cast("long"))


@query("card_details", "SELECT id, qualified, kind, path FROM symbol_rows", "symbol_rows")
def card_details(g: Graph) -> DataFrame:
    return impact.card_details(impact.cards(g), "metadata")


@query("depends_on_pattern", "SELECT a.path AS a_path, b.path AS b_path FROM files a JOIN imports i ON i.file_id = a.id JOIN files b ON b.stem = i.stem AND b.id <> a.id WHERE lower(b.path) LIKE '%1'", "files", "imports")
def depends_on_pattern(g: Graph) -> DataFrame:
    return graph.match_edges(g, "File", "DEPENDS_ON", "File", ({}, {"path": "*1"}), ("a.path", "b.path"))


@query(
    "selected_files",
    "SELECT path, size, language FROM (SELECT lower(s_name) || CASE s_suppkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.png' ELSE '/node_modules/a.js' END AS path, CAST(floor(s_acctbal * 200) AS BIGINT) AS size, CASE s_suppkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' END AS language FROM supplier) WHERE size <= 1000000 AND language IS NOT NULL",
)
def selected_files(g: Graph) -> DataFrame:
    """Suppliers as a listing of files of four endings."""
    end = F.element_at(F.array(F.lit(".py"), F.lit(".rs"), F.lit(".png"), F.lit("/node_modules/a.js")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    listing = g.table("supplier").select(F.concat(F.lower("s_name"), end).alias("path"), F.floor(F.col("s_acctbal") * 200).cast("long").alias("size"))
    return index.selected(listing)


@query("index_status", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT max(size) FROM files) AS last_indexed, (SELECT count(*) FROM files WHERE is_test) AS stale, (SELECT count(*) FROM files WHERE is_test) = 0 AS fresh", "files", "symbols")
def index_status(g: Graph) -> DataFrame:
    """Files against a listing in which those of tests have changed; their sizes stand for times."""
    now = g.files.select("path", F.lit(1).cast("long").alias("mtime"), "size", F.when(F.col("is_test"), F.lit("new")).otherwise(F.lit("old")).alias("content_hash"))
    before = g.files.select("path", F.lit(0).cast("long").alias("mtime"), "size", F.lit("old").alias("content_hash"))
    return index.status(g.files.withColumn("last_indexed", F.col("size")), g.symbols, index.classify(now, before))


@query("affected_files", "WITH c AS (SELECT path FROM files WHERE size < 0) SELECT DISTINCT a.path FROM files a JOIN imports i ON i.file_id = a.id JOIN files b ON b.stem = i.stem AND b.id <> a.id WHERE b.path IN (SELECT path FROM c) AND a.path NOT IN (SELECT path FROM c)", "files", "imports")
def affected_files(g: Graph) -> DataFrame:
    """Files that import a changed one; of all files, those with a debt count as changed."""
    changed = g.files.where("size < 0").select("path", F.lit(1).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))
    return impact.affected_files(g, changed)


# --- findings -------------------------------------------------------------------------------------------------------

_TOKEN_SQL = "(?i)\\b(?:token|secret|password|api_?key)\\s*[:=]\\s*[\"''][0-9a-f]{32,}[\"'']"
_SECRET_SQL = findings.SECRETS


@query("secrets_lines", f"SELECT path, ln AS line, 'SEC-001' AS rule_id, 'error' AS severity, '[redacted]' AS evidence FROM lines WHERE regexp_matches(line, '{_SECRET_SQL}|{_TOKEN_SQL}') AND NOT regexp_matches(trim(line), '^(#|;|//)')", "lines")
def secrets_lines(g: Graph) -> DataFrame:
    return findings.secret_lines(g.lines, f"{findings.SECRETS}|{findings.ASSIGNED_TOKENS}")


@query("license_lines", "SELECT path, ln AS line, 'LIC-001' AS rule_id, 'info' AS severity, CASE WHEN length(trim(line)) > 60 THEN left(trim(line), 60) || '…' ELSE trim(line) END AS evidence FROM lines WHERE regexp_matches(line, '(?i)licen[sc]ed? under|all rights reserved')", "lines")
def license_lines(g: Graph) -> DataFrame:
    return findings.matching_lines(g.lines, r"(?i)licen[sc]ed? under|all rights reserved", "LIC-001", "info", 60)


_NORMAL = "trim(regexp_replace(line, '\\s+', ' ', 'g'))"
_BLOCKS = (
    f"WITH k AS (SELECT path, ln, {_NORMAL} AS line FROM lines WHERE NOT regexp_matches({_NORMAL}, '^($|//|#|/\\*|\\*|import |use |package )')), "
    "w AS (SELECT path, ln, list(line) OVER (PARTITION BY path ORDER BY ln ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM k), "
    "blocks AS (SELECT path, ln AS line, md5(array_to_string(b, chr(10))) AS digest FROM w WHERE len(b) = 4 AND strlen(array_to_string(b, chr(10))) >= 160 AND len(list_distinct(b)) >= 3) "
)


@query("dup_blocks", _BLOCKS + "SELECT * FROM blocks", "lines")
def dup_blocks(g: Graph) -> DataFrame:
    return findings.duplicate_blocks(g.lines, 4)


@query("dup_pairs", _BLOCKS + ", f AS (SELECT digest, min(struct_pack(p := path, l := line)) AS first FROM blocks GROUP BY 1 HAVING count(DISTINCT path) > 1) SELECT first.p AS first_path, path, min(struct_pack(a := line, b := first.l)).b AS first_line, min(struct_pack(a := line, b := first.l)).a AS line FROM blocks JOIN f USING (digest) WHERE path <> first.p GROUP BY 1, 2", "lines")
def dup_pairs(g: Graph) -> DataFrame:
    return findings.duplicate_pairs(findings.duplicate_blocks(g.lines, 4))


_HITS = "SELECT path, CAST(o_orderkey % 200 AS BIGINT) AS line, CAST(o_custkey % 3 AS BIGINT) AS hits FROM orders JOIN files ON id = (o_custkey + 1) % (SELECT count(*) FROM supplier)"


def _hits(g: Graph) -> DataFrame:
    k = ((F.col("o_custkey") + 1) % g.rows("supplier")).alias("id")
    return g.table("orders").select(k, (F.col("o_orderkey") % 200).alias("line"), (F.col("o_custkey") % 3).alias("hits")).join(g.files.select("id", "path"), "id").select("path", "line", "hits")


@query("coverage_changed", f"WITH h AS (SELECT path, line, sum(hits) AS hits FROM ({_HITS}) GROUP BY 1, 2), t AS (SELECT * FROM h WHERE EXISTS (SELECT 1 FROM changed_lines c WHERE c.path = h.path AND line BETWEEN c.\"start\" AND c.\"end\")) SELECT count(*) AS coverable, count(*) FILTER (hits > 0) AS covered, CAST(floor(100 * count(*) FILTER (hits > 0) / count(*)) AS BIGINT) AS percent FROM t", "files", "changed_lines")
def coverage_changed(g: Graph) -> DataFrame:
    return findings.changed_coverage(_hits(g), g.changed_lines)


#: Findings as read from line items: a rule for each mode of shipment, an evidence for each quantity.
_FINDINGS = (
    "SELECT CASE l_returnflag WHEN 'A' THEN 'DRY-001' WHEN 'N' THEN 'ALG-001' ELSE 'SEC-004' END AS rule_id, CASE l_returnflag WHEN 'A' THEN 'info' WHEN 'N' THEN 'warning' ELSE 'error' END AS severity, "
    "'supplier/' || l_suppkey AS path, l_orderkey * 8 + l_linenumber AS line, 'block at part ' || (l_partkey % 5) || ':' || l_orderkey AS evidence FROM lineitem"
)


def _findings(g: Graph) -> DataFrame:
    flag = F.col("l_returnflag")
    pick = lambda a, n, r: F.when(flag == "A", a).when(flag == "N", n).otherwise(r)
    return g.table("lineitem").select(
        pick("DRY-001", "ALG-001", "SEC-004").alias("rule_id"), pick("info", "warning", "error").alias("severity"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("line"), F.concat(F.lit("block at part "), (F.col("l_partkey") % 5).cast("string"), F.lit(":"), F.col("l_orderkey").cast("string")).alias("evidence"),
    )


_BASE = "SELECT rule_id, path, CASE WHEN rule_id LIKE 'DRY-%' THEN regexp_replace(evidence, ':[0-9]*$', '') ELSE evidence END AS evidence, arg_min(severity, line) AS severity, count(*) AS \"count\" FROM ({0}) GROUP BY 1, 2, 3"


@query("baseline_build", _BASE.format(_FINDINGS))
def baseline_build(g: Graph) -> DataFrame:
    return findings.baseline(_findings(g))


@query("baseline_filter", f"WITH f AS (SELECT *, CASE WHEN rule_id LIKE 'DRY-%' THEN regexp_replace(evidence, ':[0-9]*$', '') ELSE evidence END AS e FROM ({_FINDINGS})), k AS (SELECT rule_id, path, e, count(*) AS k FROM f WHERE line % 2 = 0 GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path, e ORDER BY line) AS n FROM f) SELECT rule_id, severity, path, line, evidence FROM n LEFT JOIN k USING (rule_id, path, e) WHERE n > coalesce(k, 0)")
def baseline_filter(g: Graph) -> DataFrame:
    made = _findings(g)
    return findings.beyond_baseline(made, findings.baseline(made.where("line % 2 = 0"))).select("rule_id", "severity", "path", "line", "evidence")


@query("suppressions", f"WITH l AS (SELECT 'supplier/' || l_suppkey AS path, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) - 1 AS ln FROM lineitem WHERE l_partkey % 3 = 0), a AS (SELECT path, ln AS line FROM l UNION SELECT path, ln + 1 FROM l) SELECT f.* FROM ({_FINDINGS}) f WHERE severity = 'error' OR rule_id <> 'ALG-001' OR NOT EXISTS (SELECT 1 FROM a WHERE a.path = f.path AND a.line = f.line)")
def suppressions(g: Graph) -> DataFrame:
    note = F.lit("# allow ALG-001 -- measured")
    lines = g.table("lineitem").where("l_partkey % 3 = 0").select(F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") - 1).cast("long").alias("ln"), note.alias("line"))
    return findings.suppressed(_findings(g), lines)


@query("rule_overrides", f"SELECT CASE rule_id WHEN 'ALG-001' THEN 'error' ELSE severity END AS severity, rule_id, count(*) AS n FROM ({_FINDINGS}) WHERE rule_id <> 'DRY-001' GROUP BY 1, 2")
def rule_overrides(g: Graph) -> DataFrame:
    rules = g.spark.createDataFrame([("DRY-001", False, None), ("ALG-001", None, "error")], "rule_id string, enabled boolean, override string")
    return findings.with_overrides(_findings(g), rules).groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("gate_status", f"WITH f AS ({_FINDINGS}), c AS (SELECT o_orderstatus <> 'P' AS success, o_orderpriority = '1-URGENT' AS required FROM orders) SELECT a.*, b.*, CASE WHEN blocking > 0 OR (SELECT count(*) FROM c WHERE NOT success AND required) > 0 THEN 'blocked' WHEN errors + warnings + infos + checks_failed > 0 THEN 'warning' ELSE 'passed' END AS status FROM (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') AS blocking FROM f) a, (SELECT count(*) FILTER (success) AS checks_passed, count(*) FILTER (NOT success) AS checks_failed FROM c) b")
def gate_status(g: Graph) -> DataFrame:
    made = _findings(g).withColumn("blocking", findings.blocks(F.col("severity")))
    checks = g.table("orders").select((F.col("o_orderstatus") != "P").alias("success"), (F.col("o_orderpriority") == "1-URGENT").alias("required"))
    return findings.gate(made, checks)


@query("gate_merge", f"WITH r AS (SELECT path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM ({_FINDINGS}) GROUP BY 1) SELECT CASE max(CASE WHEN errors > 0 THEN 2 WHEN warnings > 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'warning' ELSE 'passed' END AS status, sum(errors) AS errors, sum(warnings) AS warnings, count(*) AS repos FROM r")
def gate_merge(g: Graph) -> DataFrame:
    per = _findings(g).groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return findings.merged_gates(per.withColumn("status", F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "warning").otherwise("passed")))


@query("compact_report", f"SELECT '- ' || rule_id || ' ' || path || ':' || line || ': ' || evidence AS text FROM ({_FINDINGS}) ORDER BY path, line, rule_id LIMIT 5")
def compact_report(g: Graph) -> DataFrame:
    return findings.compact_report(_findings(g))


# --- files and indexing ---------------------------------------------------------------------------------------------

_PATHS = "SELECT c_custkey AS id, lower(c_mktsegment) || '/' || CASE c_custkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'docs/' ELSE 'src/' END || 'file' || c_custkey || CASE c_custkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.yaml' WHEN 4 THEN '_test.go' WHEN 5 THEN '.rs' WHEN 6 THEN '.csproj' ELSE '' END AS path FROM customer"


def _paths(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("tests/", "node_modules/", "docs/", "src/", "src/")]), (k % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*[F.lit(x) for x in (".py", ".test.ts", ".md", ".yaml", "_test.go", ".rs", ".csproj", "")]), (k % 8 + 1).cast("int"))
    return g.table("customer").select(k.alias("id"), F.concat(F.lower("c_mktsegment"), F.lit("/"), folder, F.lit("file"), k.cast("string"), ending).alias("path"))


@query("file_classes", f"SELECT id, path LIKE '%/node_modules/%' AS excluded, path LIKE '%/tests/%' OR path LIKE '%_test.go' OR path LIKE '%.test.%' AS test, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.yaml' THEN 'yaml' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.rs' THEN 'rust' END AS language, regexp_matches(path, '[.](py|ts|go|rs)$') AS coverable, path LIKE '%.yaml' AS secret_text, path LIKE '%.csproj' AS manifest, path LIKE '%.md' AND path NOT LIKE '%/tests/%' AS documentation FROM ({_PATHS})")
def file_classes(g: Graph) -> DataFrame:
    p = F.col("path")
    return _paths(g).select(
        "id", fx.is_excluded(p).alias("excluded"), fx.is_test(p).alias("test"), fx.language(p).alias("language"), F.coalesce(fx.is_coverable(p), F.lit(False)).alias("coverable"),
        fx.is_secret_text(p).alias("secret_text"), fx.is_manifest(p).alias("manifest"), fx.is_documentation(p).alias("documentation"),
    )


@query("module_stems", f"SELECT id, lower(CASE WHEN path LIKE '%.py' OR path LIKE '%.rs' THEN 'file' || id WHEN path LIKE '%.test.ts' THEN 'file' || id || '.test' WHEN contains(regexp_replace(path, '^.*/', ''), '.') THEN regexp_replace(path, '^.*/', '') ELSE regexp_replace(path, '^.*/', '') END) AS stem FROM ({_PATHS})")
def module_stems(g: Graph) -> DataFrame:
    return _paths(g).select("id", tx.module_stem(F.col("path")).alias("stem"))


def _snapshots(g: Graph) -> tuple[DataFrame, DataFrame]:
    o = g.table("orders")
    base = o.select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("mtime"), F.floor("o_totalprice").cast("long").alias("size"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("content_hash"), F.col("o_orderkey").alias("k"))
    m = F.col("k") % 10
    new_path = F.when(m == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    listing = base.where("k % 10 <> 0").select(
        new_path.alias("path"), F.when(m.isin(2, 3), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size", F.when(m == 3, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash")
    )
    return listing, base.where("k % 10 <> 9").drop("k")


_ACTION = "CASE o_orderkey % 10 WHEN 1 THEN 'renamed' WHEN 2 THEN 'touched' WHEN 3 THEN 'parsed' WHEN 9 THEN 'parsed' ELSE 'reused' END"


@query("cdc_classify", f"SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'moved/' ELSE '' END || 'o/' || o_orderkey AS path, 'h' || o_orderkey || CASE WHEN o_orderkey % 10 = 3 THEN 'x' ELSE '' END AS content_hash, {_ACTION} AS action FROM orders WHERE o_orderkey % 10 <> 0")
def cdc_classify(g: Graph) -> DataFrame:
    return index.classify(*_snapshots(g))


@query("removed_files", "SELECT 'o/' || o_orderkey AS path FROM orders WHERE o_orderkey % 10 IN (0, 1)")
def removed_files(g: Graph) -> DataFrame:
    return index.removed(*_snapshots(g))


@query("index_report", f"SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS files, count(*) FILTER (o_orderkey % 10 <> 0 AND {_ACTION} = 'parsed') AS parsed, count(*) FILTER (o_orderkey % 10 <> 0 AND {_ACTION} IN ('reused', 'touched')) AS reused, count(*) FILTER ({_ACTION} = 'renamed') AS renamed, count(*) FILTER (o_orderkey % 10 IN (0, 1)) AS removed FROM orders")
def index_report(g: Graph) -> DataFrame:
    listing, snapshot = _snapshots(g)
    return index.report(index.classify(listing, snapshot), index.removed(listing, snapshot))


@query("upserted_files", "SELECT 'o/' || o_orderkey AS path, count(*) AS n, max(o_custkey + CASE WHEN o_orderkey % 10 IN (2, 3) THEN 1 ELSE 0 END) AS mtime FROM orders WHERE o_orderkey % 10 NOT IN (1) GROUP BY 1 UNION ALL SELECT p || 'o/' || o_orderkey, 1, o_custkey FROM orders, (SELECT unnest(['moved/', '']) AS p) WHERE o_orderkey % 10 = 1")
def upserted_files(g: Graph) -> DataFrame:
    listing, snapshot = _snapshots(g)
    return index.upserted(snapshot, listing, "path").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("mtime"))


# --- sessions -------------------------------------------------------------------------------------------------------


def _events(g: Graph) -> DataFrame:
    return _as_events(g.table("events"))


def _as_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("state"), "value")


_EV = "SELECT event_id, user_id AS session, epoch_us(ts) AS t_at, event_type AS state, value FROM events"


@query("retry_budget", f"WITH e AS ({_EV}), n AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY session ORDER BY t_at, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY t_at, event_id) AS attempts FROM r) SELECT event_id, session, state, attempts, attempts - 1 AS stalled, attempts > 3 OR attempts - 1 >= 2 AS exhausted FROM p")
def retry_budget(g: Graph) -> DataFrame:
    return sessions.retry_budget(_events(g)).select("event_id", "session", "state", "attempts", "stalled", "exhausted")


_DAY = 86_400_000_000


@query("replay_dedup", f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session, state ORDER BY t_at, event_id) AS k FROM ({_EV})), f AS (SELECT event_id, session, state, t_at, k, t_at AS anchor FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.session, e.state, e.t_at, e.k, CASE WHEN e.t_at - f.anchor >= {_DAY} THEN e.t_at ELSE f.anchor END FROM f JOIN e ON e.session = f.session AND e.state = f.state AND e.k = f.k + 1) SELECT event_id, session, state, anchor <> t_at AS replayed FROM f")
def replay_dedup(g: Graph) -> DataFrame:
    return sessions.replays(_events(g), _DAY).select("event_id", "session", "state", "replayed")


@query("ttl_cache", f"WITH e AS (SELECT *, value < 20 AS success FROM ({_EV})) SELECT event_id, state, coalesce(t_at - max(CASE WHEN success THEN t_at END) OVER (PARTITION BY session, state ORDER BY t_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {2 * _DAY}, false) AS hit FROM e")
def ttl_cache(g: Graph) -> DataFrame:
    events = _events(g).withColumn("success", F.col("value") < 20).withColumn("name", F.col("state")).withColumn("state", F.concat_ws("/", F.col("session").cast("string"), "state"))
    return sessions.cached(events, 2 * _DAY).select("event_id", F.col("name").alias("state"), "hit")


@query("last_states", f"SELECT * FROM (SELECT event_id, session, state, row_number() OVER (PARTITION BY session ORDER BY t_at DESC, event_id DESC) AS age FROM ({_EV})) WHERE age <= 16")
def last_states(g: Graph) -> DataFrame:
    return sessions.last_states(_events(g)).select("event_id", "session", "state", "age")


@query("scope_drift", f"WITH p AS (SELECT session, state || '/' || CAST(floor(value) % 5 AS BIGINT) || '/' || event_id AS path FROM ({_EV})), s AS (SELECT DISTINCT session, CASE session % 3 WHEN 0 THEN '.' WHEN 1 THEN 'click' ELSE 'view/2' END AS scope FROM ({_EV})) SELECT p.session, p.path FROM p JOIN s USING (session) WHERE NOT (scope = '.' OR p.path = scope OR starts_with(p.path, scope || '/'))")
def scope_drift(g: Graph) -> DataFrame:
    e = _events(g)
    path = F.concat_ws("/", "state", (F.floor("value") % 5).cast("string"), F.col("event_id").cast("string"))
    m = F.col("session") % 3
    scopes = e.select("session", F.when(m == 0, ".").when(m == 1, "click").otherwise("view/2").alias("scope")).distinct()
    return sessions.outside_scope(e.select("session", path.alias("path")), scopes)


# --- evaluation -----------------------------------------------------------------------------------------------------


@query("precision_recall", "WITH p AS (SELECT quality = 0 AS expected, regexp_matches(text, '[#*$%&|]{3}') OR text LIKE '%!! %' AS found FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (expected AND found) AS tp, count(*) FILTER (NOT expected AND found) AS fp, count(*) FILTER (expected AND NOT found) AS fn FROM p) SELECT *, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall FROM c")
def precision_recall(g: Graph) -> DataFrame:
    held = g.table("labels").join(g.table("documents").select("doc_id", "text"), "doc_id")
    return evaluation.precision_recall(held.select((F.col("quality") == 0).alias("expected"), (F.col("text").rlike(r"[#*$%&|]{3}") | F.col("text").contains("!! ")).alias("found")))


_TRIALS = "SELECT conv_id AS task, role AS arm, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE CAST(length(text) AS DOUBLE) END AS reward FROM conversations"


def _trials(g: Graph) -> DataFrame:
    n = F.length("text")
    return g.table("conversations").select(F.col("conv_id").alias("task"), F.col("role").alias("arm"), F.when(n % 5 != 0, n.cast("double")).alias("reward"))


@query("trial_arms", f"SELECT arm, count(*) AS trials, count(reward) AS scored, round(avg(reward), 6) AS mean_reward FROM ({_TRIALS}) GROUP BY 1")
def trial_arms(g: Graph) -> DataFrame:
    return evaluation.arms(_trials(g))


@query("paired_trials", f"WITH m AS (SELECT task, arm, avg(reward) AS reward FROM ({_TRIALS}) GROUP BY 1, 2), a AS (SELECT task, reward AS a, true AS in_a FROM m WHERE arm = 'user'), b AS (SELECT task, reward AS b, true AS in_b FROM m WHERE arm = 'assistant'), j AS (SELECT *, b - a AS d FROM a FULL JOIN b USING (task)) SELECT count(*) FILTER (in_a AND in_b) AS matched, count(*) FILTER (in_a AND in_b AND d IS NOT NULL) AS scored, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(avg(d), 6) AS mean_delta, count(*) FILTER (in_b IS NULL) AS control_only, count(*) FILTER (in_a IS NULL) AS treatment_only FROM j")
def paired_trials(g: Graph) -> DataFrame:
    return evaluation.paired(_trials(g), "user", "assistant")


# --- syntax ---------------------------------------------------------------------------------------------------------

_STATEMENTS = "SELECT l_partkey AS file_id, CASE WHEN l_returnflag = 'R' THEN 'handler' WHEN l_returnflag = 'N' THEN 'branch' WHEN l_linestatus = 'F' THEN 'nested' ELSE 'loop' END AS s FROM lineitem"


def _nodes(g: Graph, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    return python_ast.nodes(python_sources(g), kinds, columns)


@query("complexity", f"SELECT file_id, 'order_report_' || file_id AS name, 1 + sum(CASE s WHEN 'nested' THEN 2 ELSE 1 END) AS complexity FROM ({_STATEMENTS}) GROUP BY 1")
def complexity(g: Graph) -> DataFrame:
    return syntax.complexity(_nodes(g, syntax.COUNTED, syntax.COUNTED_COLUMNS)).select("file_id", "name", "complexity")


@query("nested_loops", f"SELECT file_id, count(*) AS loops FROM ({_STATEMENTS}) WHERE s = 'nested' GROUP BY 1")
def nested_loops(g: Graph) -> DataFrame:
    return syntax.nested_loops(_nodes(g, ("loop",), ("kind", "start_line", "depth", "bounded"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("loops"))


@query("lookups_in_loops", f"SELECT file_id, 'total.index' AS name, count(*) AS calls FROM ({_STATEMENTS}) WHERE s = 'nested' GROUP BY 1")
def lookups_in_loops(g: Graph) -> DataFrame:
    return syntax.calls_in_loops(_nodes(g, ("call",), ("kind", "start_line", "depth", "name")), syntax.LOOKUPS).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("calls"))


@query("swallowed_errors", f"SELECT file_id, count(*) AS handlers FROM ({_STATEMENTS}) WHERE s = 'handler' GROUP BY 1")
def swallowed_errors(g: Graph) -> DataFrame:
    return syntax.swallowed(_nodes(g, ("handler",), ("kind", "start_line", "name"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("handlers"))


@query("behavioural_duplicates", "WITH b AS (SELECT l_partkey AS id, string_agg(CASE WHEN l_returnflag = 'R' THEN 'h' WHEN l_returnflag = 'N' THEN 'b' WHEN l_linestatus = 'F' THEN 'n' ELSE 'l' END, '' ORDER BY l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'q' WHEN l_returnflag = 'N' THEN 'p' WHEN l_linestatus = 'F' THEN 'o2' ELSE 'o1' END) AS form FROM lineitem GROUP BY 1), k AS (SELECT id, form, array_to_string(list_sort(list_distinct(list_transform(string_split(form, ''), lambda c: CASE c WHEN 'h' THEN 'load_order' WHEN 'b' THEN 'sort' WHEN 'n' THEN 'index' ELSE 'append' END))), ',') AS calls, len(list_distinct(string_split(form, ''))) AS n FROM b), w AS (SELECT k.*, unnest(['order', 'report']) AS domain FROM k WHERE n >= 3), f AS (SELECT domain, calls, arg_min(form, id) AS form, min(id) AS first_file FROM w GROUP BY 1, 2 HAVING count(DISTINCT form) > 1) SELECT first_file, 'order_report_' || first_file AS first_name, w.id AS file_id, 'order_report_' || w.id AS name, domain FROM w JOIN f USING (domain, calls) WHERE w.form <> f.form")
def behavioural_duplicates(g: Graph) -> DataFrame:
    return syntax.behavioural_duplicates(extraction.functions(_cut(_nodes(g))))


_CLOSURE = "WITH RECURSIVE c AS (SELECT DISTINCT s.name AS caller, c.callee FROM calls c JOIN symbols s ON s.id = c.symbol_id), r AS (SELECT 'small ring' AS name UNION SELECT c.caller FROM r JOIN c ON c.callee = r.name) "


@query("call_closure", f"{_CLOSURE} SELECT name FROM r", "symbols", "calls")
def call_closure(g: Graph) -> DataFrame:
    return _call_closure(g, g.calls)


def _call_closure(g: Graph, calls: DataFrame) -> DataFrame:
    pairs = calls.join(g.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("caller")), "symbol_id").select("caller", "callee")
    return syntax.reaching(pairs, g.symbols.where("name = 'small ring'").select("name").unionByName(pairs.where("callee = 'small ring'").select(F.col("callee").alias("name"))))


@query("session_decisions", f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session, state ORDER BY t_at, event_id) AS k FROM ({_EV})), f AS (SELECT event_id, session, state, t_at, k, t_at AS anchor FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.session, e.state, e.t_at, e.k, CASE WHEN e.t_at - f.anchor >= {_DAY} THEN e.t_at ELSE f.anchor END FROM f JOIN e ON e.session = f.session AND e.state = f.state AND e.k = f.k + 1), n AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY session ORDER BY t_at, event_id) IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY t_at, event_id) AS attempts FROM r) SELECT event_id, p.session, p.state, attempts, attempts - 1 AS stalled, attempts > 3 OR attempts - 1 >= 2 AS exhausted, anchor <> f.t_at AS replayed FROM p JOIN f USING (event_id)")
def session_decisions(g: Graph) -> DataFrame:
    stream = g.spark.readStream.schema(g.table("events").schema).parquet(f"{g.dir}/events.parquet*")
    return session_stream.worked_off(session_stream.decisions(_as_events(stream), _DAY))


# --- extraction and records -----------------------------------------------------------------------------------------


@query("extracted_symbols", "SELECT l_partkey AS file_id, 'order_report_' || l_partkey AS qualified, 'function' AS kind, 1 AS start_line, 3 + sum(CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_returnflag = 'N' THEN 2 WHEN l_linestatus = 'F' THEN 3 ELSE 2 END) AS end_line, true AS exported FROM lineitem GROUP BY 1")
def extracted_symbols(g: Graph) -> DataFrame:
    return extraction.symbols(_cut(extraction.symbol_nodes(_nodes(g, extraction.SYMBOL_KINDS, extraction.SYMBOL_COLUMNS)))).select("file_id", "qualified", "kind", "start_line", "end_line", "exported")


@query("extracted_calls", f"SELECT file_id, CASE s WHEN 'handler' THEN 'load_order' WHEN 'branch' THEN 'sort' WHEN 'nested' THEN 'index' ELSE 'append' END AS callee, CASE s WHEN 'handler' THEN NULL WHEN 'branch' THEN 'xs' ELSE 'total' END AS qualifier, count(*) AS n FROM ({_STATEMENTS}) GROUP BY ALL")
def extracted_calls(g: Graph) -> DataFrame:
    nodes = _cut(_nodes(g, extraction.CALL_KINDS, extraction.CALL_COLUMNS))
    held = extraction.calls(nodes, extraction.symbols(nodes))
    return held.groupBy("file_id", "callee", "qualifier").agg(F.count(F.lit(1)).alias("n"))


@query("symbol_hashes", "SELECT file_id, md5(string_agg(lpad(CAST(start_line AS VARCHAR), 12, '0') || '|' || lpad(CAST(id AS VARCHAR), 20, '0') || '|' || qualified || '|' || kind, chr(10) ORDER BY start_line, id)) AS symbols_hash FROM symbols GROUP BY 1", "symbols")
def symbol_hashes(g: Graph) -> DataFrame:
    return findings.fingerprints(g.symbols)


_PAYLOADS = "SELECT l_orderkey * 8 + l_linenumber AS event_id, l_linenumber AS n, l_suppkey AS s, l_partkey AS p FROM lineitem"


def _payloads(g: Graph) -> DataFrame:
    """A tool's payload for each line item, whose table and files stand at a depth of twice its number."""
    n = F.col("l_linenumber")
    inner = F.format_string('{"table": " t%d ", "files": ["f%d.py", "g.py"], "n": 1}', "l_suppkey", "l_partkey")
    deep = F.concat(F.repeat(F.lit('{"deep": ['), n), inner, F.repeat(F.lit("]}"), n))
    return g.table("lineitem").select((F.col("l_orderkey") * 8 + n).alias("event_id"), F.concat(F.lit('{"tool_name": "mcp__srv__x", "tool_input": '), deep, F.lit("}")).alias("payload"))


@query("tool_resources", f"SELECT event_id, 'mcp:srv/x' AS resource FROM ({_PAYLOADS}) UNION SELECT event_id, 'table:t' || s FROM ({_PAYLOADS})")
def tool_resources(g: Graph) -> DataFrame:
    return payloads.resources(_payloads(g))


@query("tool_paths", f"SELECT event_id, 'f' || p || '.py' AS path FROM ({_PAYLOADS}) UNION SELECT event_id, 'g.py' FROM ({_PAYLOADS})")
def tool_paths(g: Graph) -> DataFrame:
    return payloads.paths(_payloads(g))


@query("payload_leaves", f"SELECT event_id, '$.tool_input' || repeat('.deep[0]', n) || '.table' AS path, ' t' || s || ' ' AS value FROM ({_PAYLOADS})")
def payload_leaves(g: Graph) -> DataFrame:
    """Where the table stands in each payload."""
    return payloads.leaves(_payloads(g)).where("name = 'table'").select("event_id", "path", "value")


_IGNORE = (("", 0, "node_modules/"), ("", 1, "*.rs"), ("", 2, "!/*/src/file1*.rs"), ("automobile", 0, "docs"), ("building", 0, "tests/*.ts"), ("building/src", 0, "!*.rs"))


@query(
    "ignored_files",
    f"SELECT path, path LIKE '%/node_modules/%' OR path LIKE 'automobile/docs/%' OR path LIKE 'building/tests/%.ts' OR path LIKE '%.rs' AND NOT path LIKE 'building/src/%' AND NOT path LIKE '%/src/file1%' AS ignored FROM ({_PATHS})",
)
def ignored_files(g: Graph) -> DataFrame:
    """Which of all paths the ignore files of some folders leave out."""
    return trees.ignored(_paths(g), g.spark.createDataFrame(_IGNORE, "folder string, n int, line string"))


_LINE = "regexp_replace(path, '^.*/', '') || chr(9) || kind || chr(9) || digest"
_LEVELS = (
    f"WITH a AS (SELECT path, md5(path) AS digest, 'f' AS kind FROM ({_PATHS})), "
    + ", ".join(
        f"{b} AS (SELECT {up} AS path, md5(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) AS digest, 'd' AS kind FROM {x} GROUP BY 1)"
        for x, b, up in (("a", "b", "regexp_replace(path, '/[^/]*$', '')"), ("b", "c", "regexp_replace(path, '/[^/]*$', '')"), ("c", "d", "''"))
    )
)


@query("folder_digests", f"{_LEVELS} SELECT path, digest, kind = 'd' AS is_folder FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)")
def folder_digests(g: Graph) -> DataFrame:
    """Digests of all files and folders, from the files up."""
    return trees.digests(_paths(g).select("path", F.md5(F.col("path").cast("binary")).alias("content_hash")))


@query("session_keys", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS session FROM events")
def session_keys(g: Graph) -> DataFrame:
    return findings.session_keys(g.table("events").select("event_id", F.col("props").alias("payload")))


@query("climbability", "SELECT o_orderkey AS id, 20 * (CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_custkey % 3 = 0 AS INT) + CAST(o_orderstatus = 'F' AS INT) + CAST(o_totalprice > 100000 AS INT) + CAST(o_orderpriority = '1-URGENT' AS INT)) AS score FROM orders")
def climbability(g: Graph) -> DataFrame:
    c = F.col
    has = {"has_metric": c("o_orderkey") % 2 == 0, "has_baseline": c("o_custkey") % 3 == 0, "has_target": c("o_orderstatus") == "F", "has_command": c("o_totalprice") > 100000, "has_scope": c("o_orderpriority") == "1-URGENT"}
    return findings.climbability(g.table("orders").withColumns(has)).select(c("o_orderkey").alias("id"), "score")


@query("added_placeholders", "WITH n AS (SELECT 'p' || l_suppkey AS path, l_orderkey * 8 + l_linenumber AS line, 'todo!(\"' || l_returnflag || '\")' AS evidence, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem)), k AS (SELECT path, evidence, count(*) AS k FROM n WHERE line % 5 = 0 GROUP BY 1, 2) SELECT path, line, evidence FROM n LEFT JOIN k USING (path, evidence) WHERE n > coalesce(k, 0)")
def added_placeholders(g: Graph) -> DataFrame:
    rows = g.table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag").distinct()
    now = rows.select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ln"), F.concat(F.lit('  todo!("'), "l_returnflag", F.lit('")')).alias("line"))
    return findings.added_placeholders(now, now.where("ln % 5 = 0"))


@query("reconciled_commands", "WITH c AS (SELECT DISTINCT p_brand AS name, min(p_partkey) OVER (PARTITION BY p_brand) AS place FROM part WHERE p_size < 3), d AS (SELECT s_name AS name, s_suppkey AS place FROM supplier UNION ALL SELECT p_brand, min(p_partkey) FROM part GROUP BY 1) SELECT name, place FROM c UNION ALL SELECT name, min(d.place) + (SELECT coalesce(max(place) + 1, 0) FROM c) FROM d WHERE name NOT IN (SELECT name FROM c) GROUP BY name")
def reconciled_commands(g: Graph) -> DataFrame:
    by_brand = lambda df: df.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("place")).withColumn("command", F.col("name"))
    detected = g.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("command")).unionByName(by_brand(g.table("part")))
    return findings.reconciled(by_brand(g.table("part").where("p_size < 3")), detected).select("name", "place")


@query("registry", "SELECT o_custkey AS root, max(o_orderdate) AS indexed_at, count(*) AS updates FROM orders GROUP BY 1")
def registry(g: Graph) -> DataFrame:
    rows = g.table("orders").select(F.col("o_custkey").alias("root"), F.col("o_orderdate").alias("indexed_at"))
    return store.latest(rows, "root", "indexed_at").join(rows.groupBy("root").agg(F.count(F.lit(1)).alias("updates")), "root")


@query("nested_entries", "SELECT f.id AS file_id, (SELECT count(*) FROM symbols s WHERE s.file_id = f.id) AS symbols, (SELECT count(*) FROM symbols s JOIN calls c ON c.symbol_id = s.id WHERE s.file_id = f.id) AS calls, (SELECT count(*) FROM imports i WHERE i.file_id = f.id) AS imports FROM files f", "files", "symbols", "calls", "imports")
def nested_entries(g: Graph) -> DataFrame:
    held = index.nested_entries(g.files, g.symbols, g.calls, g.imports)
    inner = F.aggregate("symbols", F.lit(0), lambda a, s: a + F.coalesce(F.size(s["calls"]), F.lit(0)))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return held.select("file_id", n(size("symbols")).alias("symbols"), n(inner).alias("calls"), n(size("imports")).alias("imports"))


@query("operations_in_loops", f"SELECT file_id, 'total.index' AS name, 'DB-001' AS rule_id, 'error' AS severity, count(*) AS n FROM ({_STATEMENTS}) WHERE s = 'nested' AND file_id % 2 = 0 GROUP BY 1 UNION ALL SELECT file_id, 'total.index', 'DB-002', 'info', count(*) FROM ({_STATEMENTS}) WHERE s = 'nested' AND file_id % 2 = 1 GROUP BY 1")
def operations_in_loops(g: Graph) -> DataFrame:
    ids = g.table("part").select(F.col("p_partkey").alias("file_id"))
    imports = ids.where("file_id % 2 = 0").withColumn("module", F.lit("sqlite3.dbapi2"))
    origin = syntax.provenance(imports, syntax.DATABASE_MODULES, ids.select("file_id", F.lit("total").alias("name"), F.lit("sqlite3").alias("source")))
    found = syntax.operations_in_loops(_nodes(g, ("call",), ("kind", "start_line", "depth", "name")), ("index",), origin, "DB")
    return found.groupBy("file_id", "name", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


_FUNCTIONS = "f AS (SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN 'auth_' ELSE 'f_' END || p_partkey AS name, p_type = 'LARGE' AS route FROM part)"


@query(
    "open_routes",
    f"WITH RECURSIVE {_FUNCTIONS}, c AS (SELECT a.name AS caller, b.name AS callee FROM f a JOIN f b ON b.id = a.id // 3 AND a.id > 0), "
    "r AS (SELECT name FROM f WHERE name LIKE 'auth%' UNION SELECT c.caller FROM r JOIN c ON c.callee = r.name) SELECT id, name AS qualified, 'POST' AS route_method FROM f WHERE route AND name NOT IN (SELECT name FROM r)",
)
def open_routes(g: Graph) -> DataFrame:
    """Parts as functions: each calls the one at a third of its key, those of size 1 check access, large ones are routes."""
    name = F.concat(F.when(F.col("p_size") == 1, F.lit("auth_")).otherwise(F.lit("f_")), F.col("p_partkey").cast("string"))
    route = F.col("p_type") == "LARGE"
    made = g.table("part").select(F.col("p_partkey").alias("id"), name.alias("name"), name.alias("qualified"), F.when(route, name).alias("route_path"), F.when(route, F.lit("POST")).alias("route_method"))
    callees = made.select(F.col("id").alias("to"), F.col("name").alias("callee"))
    calls = made.where("id > 0").select(F.col("id").alias("symbol_id"), F.floor(F.col("id") / 3).cast("long").alias("to")).join(callees, "to").select("symbol_id", "callee")
    return syntax.open_routes(made, calls)


@query(
    "open_routes_of_calls",
    "WITH r AS (SELECT 'small ring' AS name UNION SELECT s.name FROM calls c JOIN symbols s ON s.id = c.symbol_id WHERE c.callee = 'small ring') "
    "SELECT id, qualified, 'POST' AS route_method FROM symbols WHERE route_path IS NOT NULL AND name NOT IN (SELECT name FROM r)",
    "symbols",
    "calls",
)
def open_routes_of_calls(g: Graph) -> DataFrame:
    """Routes of the whole graph that call no check themselves, where what is named small ring checks access."""
    named = lambda c: F.when(F.col(c) == "small ring", "auth ring").otherwise(F.col(c))
    symbols = g.symbols.withColumn("name", named("name")).withColumn("route_method", F.when(F.col("route_path").isNotNull(), "POST"))
    return syntax.open_routes(symbols, g.calls.withColumn("callee", named("callee")), rounds=1)


@query(
    "affected_by_changes",
    "WITH c AS (SELECT DISTINCT path FROM changed_lines) SELECT DISTINCT a.path FROM files a JOIN imports i ON i.file_id = a.id JOIN files b ON b.stem = i.stem AND b.id <> a.id WHERE b.path IN (SELECT path FROM c) AND a.path NOT IN (SELECT path FROM c)",
    "files",
    "imports",
    "changed_lines",
)
def affected_by_changes(g: Graph) -> DataFrame:
    """Files that import one of which lines have changed."""
    return impact.affected_files(g, g.changed_lines)


@query("task_states")
def task_states(g: Graph) -> DataFrame:
    """Sessions of events as tasks: sign-ups start them, clicks finish todos, views report them ready, purchases pass the gate, errors urge them on."""
    stream = g.spark.readStream.schema(g.table("events").schema).parquet(f"{g.dir}/events.parquet*")
    kinds = F.create_map(*[F.lit(x) for kv in (("signup", "start"), ("click", "done"), ("view", "ready"), ("purchase", "gate"), ("error", "poke")) for x in kv])
    e = _as_events(stream).withColumn("kind", F.element_at(kinds, F.col("state")))
    text = F.when(F.col("kind") == "gate", F.lit("passed")).otherwise(F.concat(F.lit("objective "), (F.floor("value") % 3).cast("string")))
    n = F.when(F.col("kind") == "start", F.floor("value") % 3).when(F.col("kind") == "done", F.floor("value") % 3 + 1).otherwise(F.floor("value") % 101)
    return session_stream.worked_off(session_stream.task_states(e.select("event_id", "session", "at", "kind", text.alias("text"), n.cast("long").alias("n"))))
