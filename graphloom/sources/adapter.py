"""The code graph as read from the driver's tables, in Spark and, for comparison, in DuckDB SQL.

Suppliers stand for files, parts for symbols, line items for calls, orders for
changed lines, pages for outbound links. Row counts are Parquet metadata.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import module_stem

ROUTES = (("en_page", "/en/:id"), ("fr_page", "/fr/{id}"), ("de_page", "/de/<id>"), ("es_page", "/es/*"), ("deep_page", "/en/:id/index"))
KINDS = {"STANDARD": "function", "MEDIUM": "function", "PROMO": "method", "ECONOMY": "type", "SMALL": "module", "LARGE": "route"}


class Graph:
    """Lazy tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._counts: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, name: str):
        if name not in self._counts:
            self._counts[name] = self.table(name).count()
        return F.lit(self._counts[name]).cast("long")

    @property
    def files(self) -> DataFrame:
        # nation and region are fixed reference tables of 25 and 5 rows
        places = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        made = self.table("supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
        return made.select(
            F.col("s_suppkey").alias("id"), F.concat(F.lower("n_name"), F.lit("/"), F.col("s_name")).alias("path"), F.col("r_name").alias("language"),
            F.floor(F.col("s_acctbal") * 100).cast("long").alias("size"), (F.col("s_suppkey") % 7 == 0).alias("is_test"), F.lower("s_name").alias("stem"),
        )

    @property
    def symbols(self) -> DataFrame:
        n = self.rows("supplier")
        start = (F.floor(F.col("p_partkey") / n) * 10 + 1).cast("long")
        kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
        route = F.col("p_type") == "LARGE"
        return self.table("part").select(
            F.col("p_partkey").alias("id"), (F.col("p_partkey") % n).alias("file_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("container"),
            F.concat("p_brand", F.lit("."), "p_name").alias("qualified"), F.element_at(kind, F.col("p_type")).alias("kind"), start.alias("start_line"),
            (start + F.col("p_size") - 1).cast("long").alias("end_line"), F.concat("p_name", F.lit("("), "p_brand", F.lit(")")).alias("signature"),
            (F.col("p_size") % 2 == 0).alias("exported"), F.when(route, F.lit("GET")).alias("route_method"),
            F.when(route, F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/:id"))).alias("route_path"),
        )

    @property
    def calls(self) -> DataFrame:
        called = self.table("part").select("p_partkey", "p_name", "p_brand")
        made = self.table("lineitem").withColumn("k", F.col("l_orderkey") % self.rows("part")).join(called, F.col("k") == F.col("p_partkey"))
        return made.select(
            F.col("l_partkey").alias("symbol_id"), F.col("p_name").alias("callee"), F.when(F.col("l_linestatus") == "F", F.col("p_brand")).alias("receiver"),
            F.when(F.col("l_returnflag") == "R", F.lower("p_brand")).alias("qualifier"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("character"),
        )

    @property
    def extends(self) -> DataFrame:
        base = self.table("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("base"))
        return self.symbols.where("kind = 'type'").withColumn("k", (F.col("id") * 13 + 5) % self.rows("part")).join(base, "k").select(F.col("id").alias("symbol_id"), F.col("base").alias("name"))

    @property
    def imports(self) -> DataFrame:
        n = self.rows("supplier")
        to = self.files.select(F.col("id").alias("k"), F.col("path").alias("module"))
        inner = self.files.select("id").withColumn("k", (F.col("id") * 7 + 1) % n).join(to, "k").select(F.col("id").alias("file_id"), "module")
        outer = self.files.where("id % 3 = 0").select(F.col("id").alias("file_id"), F.concat(F.lit("pkg/ext"), (F.col("id") % 11).cast("string"), F.lit(".js")).alias("module"))
        return inner.unionByName(outer).withColumn("stem", module_stem(F.col("module")))

    @property
    def changed_lines(self) -> DataFrame:
        made = self.table("orders").withColumn("k", F.col("o_custkey") % self.rows("supplier")).join(self.files.select(F.col("id").alias("k"), "path"), "k")
        start = (F.col("o_orderkey") % 200).cast("long")
        return made.select("path", start.alias("start"), (start + 5).alias("end")).distinct()

    @property
    def service_links(self) -> DataFrame:
        return self.table("pages").select((F.col("page_id") % self.rows("part")).alias("symbol_id"), F.when(F.col("page_id") % 2 == 0, F.lit("get")).alias("method"), "url")

    @property
    def routes(self) -> DataFrame:
        rows = [(name, "GET" if i % 2 == 0 else None, path, f"routes/{name}") for i, (name, path) in enumerate(ROUTES)]
        return self.spark.createDataFrame(rows, "qualified string, route_method string, route_path string, path string")

    @property
    def lines(self) -> DataFrame:
        docs = self.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
        return docs.select("path", (F.col("i") + 1).cast("long").alias("ln"), "line")

    @property
    def symbol_rows(self) -> DataFrame:
        """Symbols with their files."""
        return self.symbols.join(self.files.select(F.col("id").alias("file_id"), "path", "language", "is_test"), "file_id")


_N, _P = "(SELECT count(*) FROM supplier)", "(SELECT count(*) FROM part)"
#: The same tables in DuckDB; a query names those it needs.
SQL = {
    "files": f"SELECT s_suppkey AS id, lower(n_name)||'/'||s_name AS path, r_name AS language, CAST(floor(s_acctbal*100) AS BIGINT) AS size, s_suppkey % 7 = 0 AS is_test, lower(s_name) AS stem FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "symbols": f"SELECT p_partkey AS id, p_partkey % {_N} AS file_id, p_name AS name, p_brand AS container, p_brand||'.'||p_name AS qualified, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
    + f" END AS kind, 10*(p_partkey // {_N})+1 AS start_line, 10*(p_partkey // {_N})+p_size AS end_line, p_name||'('||p_brand||')' AS signature, p_size % 2 = 0 AS exported, CASE WHEN p_type='LARGE' THEN 'GET' END AS route_method, CASE WHEN p_type='LARGE' THEN '/'||replace(p_name,' ','/')||'/:id' END AS route_path FROM part",
    "calls": f"SELECT l_partkey AS symbol_id, p_name AS callee, CASE WHEN l_linestatus='F' THEN p_brand END AS receiver, CASE WHEN l_returnflag='R' THEN lower(p_brand) END AS qualifier, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS \"character\" FROM lineitem JOIN part ON p_partkey = l_orderkey % {_P}",
    "extends": f"SELECT s.id AS symbol_id, p_name AS name FROM symbols s JOIN part ON p_partkey = (s.id*13+5) % {_P} WHERE s.kind='type'",
    "imports": f"SELECT a.id AS file_id, b.path AS module, b.stem AS stem FROM files a JOIN files b ON b.id = (a.id*7+1) % {_N} UNION ALL SELECT id, 'pkg/ext'||(id % 11)||'.js', 'ext'||(id % 11) FROM files WHERE id % 3 = 0",
    "changed_lines": f"SELECT DISTINCT path, o_orderkey % 200 AS \"start\", o_orderkey % 200 + 5 AS \"end\" FROM orders JOIN files ON id = o_custkey % {_N}",
    "service_links": f"SELECT page_id % {_P} AS symbol_id, CASE WHEN page_id % 2 = 0 THEN 'get' END AS method, url FROM pages",
    "routes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'NULL' if i % 2 else repr('GET')}, '{p}', 'routes/{n}')" for i, (n, p) in enumerate(ROUTES)) + ") t(qualified, route_method, route_path, path)",
    "lines": "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS BIGINT) AS ln, a[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a)+1)) AS i)",
    "symbol_rows": "SELECT s.*, f.path, f.language, f.is_test FROM symbols s JOIN files f ON f.id = s.file_id",
}
_NEEDS = {"extends": ("symbols",), "imports": ("files",), "changed_lines": ("files",), "symbol_rows": ("files", "symbols")}


def sql(query: str, *tables: str) -> str:
    """query with the tables that it names as CTEs before it."""
    order: list[str] = []
    for t in tables:
        for x in (*_NEEDS.get(t, ()), t):
            if x not in order:
                order.append(x)
    if not order:
        return query
    if query.startswith("WITH RECURSIVE "):
        return sql("WITH " + query[15:], *tables).replace("WITH ", "WITH RECURSIVE ", 1)
    head = ", ".join(f'"{t}" AS ({SQL[t]})' for t in order)
    return f"WITH {head} {query}" if not query.startswith("WITH ") else f"WITH {head}, {query[5:]}"


def _bodies(graph: Graph, key: str, v: Column, texts: list[str]) -> DataFrame:
    """(key, body): for each part the texts that its line items have by number, in order."""
    lines = graph.table("lineitem").select(F.col("l_partkey").alias(key), F.struct("l_orderkey", "l_linenumber", "l_suppkey", v.cast("byte").alias("v")).alias("s"))
    held = lines.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return held.select(key, F.array_join(F.transform("s", lambda s: F.get(F.array(*map(F.lit, texts)), s["v"])), "").alias("body"))


def python_sources(graph: Graph):
    """(file_id, text): a Python function for each part, with a statement for each of its line items in order.

    Returned goods are a handler, others a nested loop (status F), a loop, or a branch with a sort.
    """
    loop, nested = "    for x in xs:\n        total.append(x)\n", "    for x in xs:\n        for y in x:\n            total.index(y)\n"
    branch, handler = "    if xs:\n        xs.sort()\n", "    try:\n        load_order(xs)\n    except ValueError:\n        pass\n"
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    texts = sorted((loop, nested, branch, handler))  # their numbers move, in the order of the texts
    v = F.when(flag == "R", texts.index(handler)).when(flag == "N", texts.index(branch)).when(status == "F", texts.index(nested)).otherwise(texts.index(loop))
    bodies = _bodies(graph, "l_partkey", v, texts)
    head = F.concat(F.lit("def order_report_"), F.col("l_partkey").cast("string"), F.lit("(xs):\n    total = []\n"))
    return bodies.select(F.col("l_partkey").alias("file_id"), F.concat(head, F.col("body"), F.lit("    return total\n")).alias("text"))


@dataclass(frozen=True)
class Statement:
    """Python code that a line item stands for, the rules that it breaks, the branches that it adds, and its lines."""

    text: str
    rules: tuple[str, ...] = ()
    branches: int = 0


#: DB and NET stand for rules 001 where the file imports what is called, and 002 where it does not.
STATEMENTS = (
    Statement("    ys = [db.execute(x) for x in xs.find()]\n", ("DB", "SEC-003"), 1),
    Statement("    for x in range(3):\n        for y in range(2, 9):\n            total.append(y)\n", (), 2),
    Statement("    for x in xs:\n        for y in x:\n            total.index(y)\n", ("ALG-001", "ALG-002"), 2),
    Statement("    try:\n        def inner(a):\n            return load(a)\n    except ValueError:\n        pass\n", ("ERR-001",), 1),
    Statement("    for x in xs.sort():\n        x.sort()\n", ("ALG-003",), 1),
    Statement("    eval(xs)\n", ("SEC-003",)),
    Statement("    exec(settings())\n", ("SEC-002",)),
    Statement('    digest = hashlib.md5(b"x")\n', ("SEC-004",)),
    Statement("    requests.get(url, verify=False)\n", ("SEC-004",)),
    Statement("    doc = yaml.load(cfg)\n", ("SEC-005",)),
    Statement("    doc = yaml.load(cfg, Loader=yaml.SafeLoader)\n"),
    Statement('    rows = db.query("SELECT * FROM t")\n', ("DB-005",)),
    Statement("    for x in xs:\n        requests.get(x)\n", ("NET", "SEC-003"), 1),
    Statement("    done = asyncio.gather(*[work(x) for x in xs])\n", ("CON-001",), 1),
    Statement("    page = Markup(xs)\n", ("SEC-006",)),
    Statement("    text = open(secure_filename(xs))\n    more = open(xs)\n", ("SEC-007",)),
    Statement("    if xs:\n        class Inner:\n            def method(self):\n                return self.other(xs)\n", (), 1),
)
STATEMENT_SQL = f"SELECT l_partkey AS file_id, (l_suppkey + 5 * l_linenumber + l_orderkey) % {len(STATEMENTS)} AS v FROM lineitem"


def varied_sources(graph: Graph):
    """(file_id, path, text): a Python file for each part, with a function of a statement for each of its line items in order.

    Even files take db from a database, every third file imports a client, every 97th cannot be parsed.
    """
    v = F.pmod(F.col("l_suppkey") + 5 * F.col("l_linenumber") + F.col("l_orderkey"), F.lit(len(STATEMENTS))).cast("int")
    bodies = _bodies(graph, "file_id", v, [s.text for s in STATEMENTS])
    k = F.col("file_id")
    imports = F.concat(F.when(k % 3 == 0, "import requests\n").otherwise(""), F.when(k % 2 == 0, 'import sqlite3\ndb = sqlite3.connect("x")\n').otherwise(""))
    head = F.concat(F.lit("def report_"), k.cast("string"), F.lit("(xs, cfg):\n    total = []\n"))
    broken = F.when(k % 97 == 0, "    return (\n").otherwise("    return total\n")
    return bodies.select("file_id", F.concat(F.lit("src/report_"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(imports, head, F.col("body"), broken).alias("text"))


#: What the function of a part does with its parameter x, by the part's number modulo 6; {q} is the part whose function it calls.
LINKED = (
    "    db.query(x)\n",
    "    return step_{q}(x)\n",
    "    return step_{q}(shlex.quote(x))\n",
    "    os.system(x)\n",
    "    y = step_{q}(other=1, x=x)\n    open(y)\n",
    "    return x\n",
)


def linked_sources(graph: Graph, kind: Column | None = None):
    """(file_id, path, text): a Python file for each part p, with a function step_p that calls that of part (7 p + 3) modulo their number, as LINKED says.

    Every fourth file gives an outer value to its own function, every 50th has a function of a name that others have, too. kind says which of LINKED
    a part has, if not its number modulo 6.
    """
    n = graph.table("part").count()
    p = F.col("p_partkey")
    q = ((p * 7 + 3) % n).cast("string")
    body = F.replace(F.get(F.array(*[F.lit(x) for x in LINKED]), (p % len(LINKED) if kind is None else kind).cast("int")), F.lit("{q}"), q)
    name = F.when(p % 50 == 49, F.lit("step_shared")).otherwise(F.concat(F.lit("step_"), p.cast("string")))
    head = F.concat(F.lit("def "), name, F.lit("(x, other=None):\n"), body)
    main = F.when(p % 4 == 0, F.concat(F.lit("def main_"), p.cast("string"), F.lit("(request):\n    step_"), p.cast("string"), F.lit("(request.args)\n"))).otherwise(F.lit(""))
    return graph.table("part").select(p.alias("file_id"), F.concat(F.lit("flow/step_"), p.cast("string"), F.lit(".py")).alias("path"), F.concat(head, main).alias("text"))


#: Parts with their kind k, the part q that they call, whether their function's name is its own, and whether q's is.
LINKED_SQL = "SELECT p_partkey AS p, p_partkey % 6 AS k, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS q, p_partkey % 50 <> 49 AS own, ((p_partkey * 7 + 3) % (SELECT count(*) FROM part)) % 50 <> 49 AS known FROM part"
