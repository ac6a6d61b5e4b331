import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation, extraction, findings, graph, impact, index, search, sessions, syntax, trace
from graphloom.sources import python_ast, reports, store
from graphloom.streaming import session as session_stream
from graphloom.streaming import watch


class Small:
    """Two files: a login handler that calls validate, a client, a service with its base."""

    def __init__(self, spark):
        self.spark = spark
        files = [(1, "src/login.rs", "rust", "login", False), (2, "tests/client.rs", "rust", "client", True)]
        self.files = spark.createDataFrame(files, "id long, path string, language string, stem string, is_test boolean")
        rows = [
            (1, 1, "handle_login", None, "handle_login", "function", 1, 9, "fn handle_login()", True, "POST", "/login"), (2, 2, "call_login", None, "call_login", "function", 1, 5, "fn call_login()", False, None, None),
            (3, 1, "AuthService", None, "AuthService", "type", 10, 20, "struct AuthService", True, None, None), (4, 1, "validate", "AuthService", "AuthService.validate", "method", 12, 15, "fn validate()", True, None, None),
            (5, 1, "Service", None, "Service", "type", 30, 40, "trait Service", True, None, None),
        ]
        self.symbols = spark.createDataFrame(rows, "id long, file_id long, name string, container string, qualified string, kind string, start_line long, end_line long, signature string, exported boolean, route_method string, route_path string")
        self.calls = spark.createDataFrame([(1, "validate", "AuthService", None, 3, 4), (1, "validate", None, "svc", 5, 4), (2, "handle_login", None, None, 2, 0)], "symbol_id long, callee string, receiver string, qualifier string, line long, character long")
        self.extends = spark.createDataFrame([(3, "Service")], "symbol_id long, name string")
        self.imports = spark.createDataFrame([(2, "crate::login", "login"), (1, "serde", "serde")], "file_id long, module string, stem string")
        self.service_links = spark.createDataFrame([(2, "post", "https://api/login")], "symbol_id long, method string, url string")

    @property
    def symbol_rows(self):
        return self.symbols.join(self.files.select(F.col("id").alias("file_id"), "path", "language", "is_test"), "file_id")


@pytest.fixture(scope="module")
def small(spark):
    return Small(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_relations(small):
    ask = lambda *x, **k: rows(graph.match_edges(small, *x, **k))
    assert ask("Function", "CALLS", "Method") == [("handle_login", "validate")]
    assert ask("Method", "CALLED_BY", "Function") == [("validate", "handle_login")]
    assert ask("Type", "EXTENDS", "Type") == [("AuthService", "Service")]
    assert ask("Type", "IMPLEMENTED_BY", "Type") == [("Service", "AuthService")]
    assert ask("File", "CONTAINS", "Method", returns=("a.path", "b.name")) == [("src/login.rs", "validate")]
    assert ask("File", "IMPORTS", "File", returns=("a.name", "b.name")) == [("client", "login")]
    assert ask("Function", "ROUTES_TO", "Function") == [("call_login", "handle_login")]
    with pytest.raises(ValueError):
        graph.match_edges(small, "Function", "CONTAINS", "Method")
    with pytest.raises(ValueError):
        graph.match_edges(small, "Function", "OWNS", "Method")


def test_lookup_is_in_two_stages(small):
    assert rows(graph.find_symbols(small.symbols, "Service").select("name")) == [("Service",)]
    assert rows(graph.find_symbols(small.symbols, "service").select("name")) == [("AuthService",), ("Service",), ("validate",)]
    assert rows(graph.find_symbols(small.symbols, "handle%login", escape=False).select("name")) == [("handle_login",)]
    assert rows(graph.find_symbols(small.symbols, "handle%login").select("name")) == []


def test_fans(small):
    assert rows(graph.fan_counts(small.calls, small.symbols).where("id IN (1, 4)")) == [(1, 1, 2), (4, 2, 0)]
    assert rows(graph.callers(small.calls, small.symbols).where("id = 4")) == [(4, 1, 2)]


def test_search(small):
    found = search.bm25(search.documents(small.symbol_rows), "auth validate", 10).collect()
    assert [r.qualified for r in found] == ["AuthService.validate", "AuthService"]
    assert search.bm25(search.documents(small.symbol_rows), "zzz", 10).count() == 0 and search.bm25(search.documents(small.symbol_rows), "--", 10).count() == 0


def test_trace(small):
    assert rows(trace.trace(small.calls, small.symbol_rows, "call_login", "outbound", 99).select("qualified", "depth", "via")) == [("AuthService.validate", 2, "handle_login"), ("handle_login", 1, "call_login")]


def test_impact(small, spark):
    changed = spark.createDataFrame([("src/login.rs", 14, 14), ("src/login.rs", 13, 99)], "path string, start long, end long")
    got = {r.qualified: r for r in impact.impact(small, changed).collect()}
    assert set(got) == {"AuthService.validate", "AuthService", "Service"}
    assert (got["AuthService.validate"].callers, got["AuthService.validate"].level) == (2, "medium")
    assert rows(impact.affected_files(small, changed)) == [("tests/client.rs",)]


def finding(spark, made):
    return spark.createDataFrame(made, "rule_id string, severity string, path string, line long, evidence string")


def test_secrets_and_suppression(spark):
    lines = spark.createDataFrame([("a", 1, "# ghp_" + "a" * 40), ("a", 2, 'key = "AKIA' + "A" * 16 + '"'), ("b", 1, "-----BEGIN PRIVATE KEY-----")], "path string, ln long, line string")
    assert rows(findings.secret_lines(lines).select("path", "line", "evidence")) == [("a", 2, "[redacted]"), ("b", 1, "[redacted]")]
    found = finding(spark, [("ALG-001", "warning", "a", 5, ""), ("ALG-001", "warning", "a", 6, ""), ("ALG-001", "error", "a", 5, ""), ("ALG-001", "warning", "a", 7, "")])
    notes = spark.createDataFrame([("a", 4, "// allow ALG-001 -- bounded"), ("a", 7, "// allow ALG-001 -- ")], "path string, ln long, line string")
    assert rows(findings.suppressed(found, notes).select("line", "severity")) == [(5, "error"), (6, "warning"), (7, "warning")]


def test_duplicates(spark):
    block = [f"let value_{i} = compute_something_long({i}, other_argument_{i});" for i in range(6)]
    made = [("a", i + 1, x) for i, x in enumerate(block)] + [("b", i + 1, x) for i, x in enumerate(["// note", *block])] + [("c", i + 1, "same") for i in range(9)]
    lines = spark.createDataFrame(made, "path string, ln long, line string")
    assert rows(findings.duplicate_pairs(findings.duplicate_blocks(lines))) == [("a", "b", 1, 2)]


def test_baseline(spark, tmp_path):
    old = finding(spark, [("DRY-001", "info", "a", 3, "block at b:3"), ("X-1", "warning", "a", 9, "e")])
    known = findings.baseline(old)
    new = finding(spark, [("DRY-001", "info", "a", 30, "block at b:77"), ("X-1", "error", "a", 10, "e"), ("X-1", "error", "a", 11, "e")])
    assert rows(findings.beyond_baseline(new, known).select("rule_id", "line")) == [("X-1", 11)]
    for version, count, ok in ((2, 1, True), (1, 0, True), (2, 0, False), (3, 1, False)):
        p = tmp_path / f"b{version}{count}.json"
        p.write_text('{"version": %d, "findings": [{"rule_id": "X-1", "path": "a", "evidence": "e", "severity": "error", "count": %d}]}' % (version, count))
        if ok:
            assert rows(reports.read_baseline(spark, str(p)).select("count")) == [(1,)]
        else:
            with pytest.raises(Exception):
                reports.read_baseline(spark, str(p)).collect()


def test_coverage_and_diff(spark, tmp_path):
    (tmp_path / "lcov.info").write_text("SF:src/a.rs\nDA:1,0\nDA:2,1\nDA:3,0\nend_of_record\nSF:src/a.rs\nDA:3,0\nend_of_record\n")
    (tmp_path / "d.diff").write_text("--- a/src/a.rs\n+++ b/src/a.rs\n@@ -1,0 +2,2 @@ fn\n+x\n+y\n@@ -9 +0,0 @@\n-z\n")
    changed = reports.diff(spark, str(tmp_path / "d.diff"))
    assert rows(changed) == [("src/a.rs", 2, 3)]
    assert rows(findings.changed_coverage(reports.lcov(spark, str(tmp_path / "lcov.info")), changed)) == [(2, 1, 50)]
    assert rows(findings.changed_coverage(reports.lcov(spark, str(tmp_path / "lcov.info")), changed.limit(0))) == [(0, 0, None)]


def test_gate_and_sarif(spark):
    found = finding(spark, [("X-1", "warning", "a", 1, "e")])
    checks = lambda *x: spark.createDataFrame(list(x), "success boolean, required boolean")
    status = lambda f, c, **k: findings.gate(f.withColumn("blocking", findings.blocks(F.col("severity"), **k)), c).first().status
    assert status(found, checks((True, True))) == "warning" and status(found, checks((False, True))) == "blocked" and status(found.limit(0), checks((True, True))) == "passed"
    assert status(found, checks((True, True)), mode="strict") == "blocked" and status(found, checks((True, True)), mode="lite", warnings_block=True) == "warning"
    assert '"ruleId":"X-1"' in findings.sarif_results(found).first().json


LISTING = "path string, mtime long, size long, content_hash string"


def test_index_lifecycle(spark):
    old = spark.createDataFrame([("a", 1, 1, "A"), ("b", 1, 1, "B"), ("c", 1, 1, "C"), ("d", 1, 1, "D")], LISTING)
    new = spark.createDataFrame([("a", 1, 1, "A"), ("b", 2, 1, "B"), ("c", 2, 1, "CC"), ("moved", 1, 1, "D"), ("copy", 1, 1, "A")], LISTING)
    acts = index.classify(new, old)
    assert rows(acts.select("path", "action")) == [("a", "reused"), ("b", "touched"), ("c", "parsed"), ("copy", "parsed"), ("moved", "renamed")]
    assert rows(index.report(acts, index.removed(new, old))) == [(5, 2, 2, 1, 1)]
    assert rows(index.removed(new, old, spark.createDataFrame([("a",)], "path string"))) == []


def listing_of(spark, texts, mtimes=None):
    import hashlib

    made = [(path, (mtimes or {}).get(path, 1), len(t), hashlib.md5(t.encode()).hexdigest(), t) for path, t in texts.items()]
    return spark.createDataFrame(made, "path string, mtime long, size long, content_hash string, text string")


def contents(held):
    return {name: rows(held.table(name).drop("last_indexed")) for name in [*store.TABLES, "edges"]}


def test_index_refreshed_by_a_diff_equals_a_full_one(spark, tmp_path):
    import pathlib

    before = {f"m{i}.py": f"def f{i}(x):\n    return f{i + 1}(x)\n" for i in range(12)}
    before["a.py"] = "class A:\n    def run(self):\n        self.go()\n    def go(self):\n        f3(1)\n"
    after = {k: v for k, v in before.items() if k not in ("m5.py", "m9.py")}
    after["m2.py"] = "def g2(x):\n    return f8(x)\n"
    after["moved.py"] = before["m5.py"]
    after["new.py"] = "def f9(y):\n    f0(y)\n    requests.get('/u')\n"
    s = store.Index(spark, f"{tmp_path}/kept", buckets=16)
    assert s.table("files").count() == 0 and s.table("edges").count() == 0
    assert rows(s.refresh(listing_of(spark, before), store.parsed_files)) == [(13, 13, 0, 0, 0)]
    parts = lambda: {str(p.relative_to(tmp_path)) for p in pathlib.Path(tmp_path, "kept").rglob("bucket=*/*.parquet")}
    first = parts()
    assert rows(s.refresh(listing_of(spark, before), store.parsed_files)) == [(13, 0, 13, 0, 0)] and parts() == first
    assert rows(s.refresh(listing_of(spark, after, {"m1.py": 7, "m2.py": 2}), store.parsed_files)) == [(13, 2, 10, 1, 2)]
    whole = store.Index(spark, f"{tmp_path}/whole", buckets=16)
    whole.refresh(listing_of(spark, after, {"m1.py": 7, "m2.py": 2}), store.parsed_files)
    assert contents(s) == contents(whole) and len(contents(s)["edges"]) > 8
    kept = first & parts()
    assert len(kept) > len(first) / 3  # the files of untouched buckets are those that were written first
    s.export(f"{tmp_path}/snapshot")
    other = store.Index(spark, f"{tmp_path}/other", buckets=4)
    assert other.seed(f"{tmp_path}/snapshot") and not other.seed(f"{tmp_path}/snapshot") and contents(other) == contents(s)
    nothing = spark.createDataFrame([], "path string, mtime long, size long, content_hash string, text string")
    assert rows(s.refresh(nothing, store.parsed_files, spark.createDataFrame([("m0.py",), ("a.py",)], "path string"))) == [(0, 0, 0, 0, 2)] and s.table("files").count() == 11
    s.refresh(nothing, store.parsed_files)
    assert all(not x for x in contents(s).values())


SOURCE = """
import os
def outer(xs):
    for x in xs:
        for y in x:
            if y and x:
                xs.sort()
    def inner():
        while True:
            pass
    try:
        run()
    except ValueError:
        pass
    return [z for z in xs]
"""


def test_syntax_rules(spark):
    nodes = python_ast.nodes(spark.createDataFrame([(1, SOURCE), (2, "def broken(:"), (3, None)], "file_id long, text string")).cache()
    assert rows(syntax.complexity(nodes).select("name", "complexity")) == [("inner", 2), ("outer", 7)]
    assert rows(syntax.nested_loops(nodes).select("start_line")) == [(5,)]
    assert rows(syntax.calls_in_loops(nodes, syntax.SORTS).select("start_line", "name")) == [(7, "xs.sort")]
    assert rows(syntax.swallowed(nodes).select("start_line")) == [(13,)]
    assert rows(syntax.parse_errors(nodes).select("file_id")) == [(2,)]
    big = "x = [" + ", ".join(["[1, 2]"] * 60) + "]"
    assert syntax.large_literals(python_ast.nodes(spark.createDataFrame([(1, big)], "file_id long, text string"))).count() == 1


def test_renamed_functions(spark):
    made = [(1, "def a(x):\n    y = x + 1\n    return y\n"), (2, "def b(p):\n    q = p + 1\n    return q\n"), (3, "def c(p):\n    q = p + 2\n    return q\n")]
    f = extraction.functions(python_ast.nodes(spark.createDataFrame(made, "file_id long, text string")))
    assert rows(syntax.renamed_duplicates(f)) == [(1, "a", 2, "b")]


def test_dataflow(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "a")], "caller string, callee string")
    assert rows(syntax.reaching(pairs, spark.createDataFrame([("c",)], "name string"))) == [("a",), ("b",), ("c",)]
    steps = [(1, "f", 1, "q", [], "request"), (1, "f", 2, "s", ["q"], "join"), (1, "f", 3, None, ["s"], "execute"), (1, "f", 4, "s", ["s"], "escape"), (1, "f", 5, None, ["s"], "execute")]
    st = spark.createDataFrame(steps, "file_id long, function string, line long, target string, uses array<string>, call string")
    assert rows(syntax.tainted_sinks(st, ("request",), ("execute",), ("escape",)).select("line", "variable")) == [(3, "s")]


def test_reaching_by_long_ways(spark):
    pairs = spark.createDataFrame([(f"f{i:02}", f"f{i + 1:02}") for i in range(54)], "caller string, callee string").coalesce(1)
    assert rows(syntax.reaching(pairs, spark.createDataFrame([("f54",)], "name string"))) == [(f"f{i:02}",) for i in range(55)]


EVENTS = "event_id long, session long, at long, state string"


def test_sessions(spark, tmp_path):
    made = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 10, "a"), (3, 1, 12, "a"), (4, 1, 30, "b"), (5, 1, 31, "a"), (6, 2, 0, "a")], EVENTS)
    budget = {r.event_id: (r.attempts, r.exhausted) for r in sessions.retry_budget(made).collect()}
    assert budget == {1: (1, False), 2: (2, False), 3: (3, True), 4: (1, False), 5: (1, False), 6: (1, False)}
    replay = {r.event_id: r.replayed for r in sessions.replays(made, 12).collect()}
    assert replay == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    made.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")
    got = session_stream.worked_off(session_stream.decisions(stream, 12)).collect()
    assert {r.event_id: (r.attempts, r.exhausted) for r in got} == budget and {r.event_id: r.replayed for r in got} == replay


def test_scope(spark):
    paths = spark.createDataFrame([(1, "src/a.rs"), (1, "srcs/a.rs"), (2, "x"), (3, "y")], "session long, path string")
    scopes = spark.createDataFrame([(1, "src"), (2, ".")], "session long, scope string")
    assert rows(sessions.outside_scope(paths, scopes)) == [(1, "srcs/a.rs"), (3, "y")]


def test_watch(spark, tmp_path):
    listings, snapshot = f"{tmp_path}/listings", f"{tmp_path}/snapshot"
    spark.createDataFrame([("a", 1, 1, "A"), ("b", 1, 1, "B")], LISTING).coalesce(1).write.parquet(listings)
    seen = []
    watch.watch(spark, listings, snapshot, f"{tmp_path}/checkpoint", lambda n, acts: seen.append((n, rows(acts.select("path", "action"))))).awaitTermination()
    spark.createDataFrame([("a", 1, 1, "A"), ("c", 1, 1, "C")], LISTING).coalesce(1).write.mode("append").parquet(listings)
    watch.watch(spark, listings, snapshot, f"{tmp_path}/checkpoint", lambda n, acts: seen.append((n, rows(acts.select("path", "action"))))).awaitTermination()
    assert seen == [(0, [("a", "parsed"), ("b", "parsed")]), (1, [("a", "reused"), ("c", "parsed")])]


def test_evaluation(spark):
    trials = spark.createDataFrame([("a", "c", 0.0), ("a", "t", 1.0), ("b", "c", 1.0), ("b", "t", None), ("d", "c", 1.0)], "task string, arm string, reward double")
    got = evaluation.paired(trials, "c", "t").first()
    assert (got.matched, got.scored, got.wins, got.mean_delta, got.control_only) == (2, 1, 1, 1.0, 1)
    assert evaluation.precision_recall(spark.createDataFrame([], "expected boolean, found boolean")).first().precision == 1.0


def test_extraction(spark):
    text = 'import os\nfrom a.b import c\nclass Base:\n    pass\nclass Api(Base):\n    @app.post("/users/<id>")\n    def create(self):\n        self.save()\n        x = Store()\n        x.put(1)\n        requests.get("https://h/users/7")\n    def _hide(self):\n        os.getcwd()\n'
    made = extraction.tables(python_ast.nodes(spark.createDataFrame([(1, text), (2, "def ("), (3, None)], "file_id long, text string")).cache())
    assert rows(made["symbols"].select("qualified", "kind", "exported", "route_method", "route_path")) == [
        ("Api", "type", True, None, None), ("Api._hide", "method", False, None, None), ("Api.create", "route", True, "POST", "/users/<id>"), ("Base", "type", True, None, None)
    ]
    assert rows(made["calls"].select("callee", "receiver", "qualifier")) == [("Store", None, None), ("get", None, "requests"), ("getcwd", None, "os"), ("put", "Store", "x"), ("save", "Api", "self")]
    assert rows(made["extends"].select("name")) == [("Base",)] and rows(made["imports"].select("module", "stem")) == [("a.b", "b"), ("os", "os")]
    assert rows(made["exports"].select("name")) == [("Api",), ("Base",)] and rows(made["service_links"].select("method", "url")) == [("GET", "https://h/users/7")]


def test_security_rules(spark):
    text = "import yaml\ndef f(x):\n    eval(x)\n    eval('1')\n    yaml.load(x)\n    yaml.load(x, Loader=yaml.SafeLoader)\n    pickle.loads(x)\n    asyncio.gather(*[g(i) for i in x])\n    asyncio.gather(a(), b())\n"
    nodes = python_ast.nodes(spark.createDataFrame([(1, text)], "file_id long, text string")).cache()
    assert rows(syntax.dynamic_execution(nodes).select("start_line")) == [(3,)]
    assert rows(syntax.unsafe_deserialization(nodes).select("start_line")) == [(5,), (7,)]
    assert rows(syntax.unbounded_parallel(nodes).select("start_line")) == [(8,)]


def test_node_text_is_whole(spark):
    text = f"import yaml\nyaml.load('{'x' * 600}', Loader=yaml.SafeLoader)\nyaml.load('{'x' * 600}')\n"
    (_, safe, unsafe) = text.splitlines()
    nodes = python_ast.nodes(spark.createDataFrame([(1, text)], "file_id long, text string"))
    assert [r[0] for r in rows(nodes.where("name = 'yaml.load'").select("text"))] == sorted([safe, unsafe])
    assert rows(syntax.unsafe_deserialization(nodes).select("start_line")) == [(3,)]


def test_open_routes(spark):
    symbols = spark.createDataFrame([(1, "save", "save", "/a", "POST"), (2, "drop", "drop", "/b", "delete"), (3, "show", "show", "/c", "GET"), (4, "guard", "guard", None, None)], "id long, name string, qualified string, route_path string, route_method string")
    calls = spark.createDataFrame([(1, "guard"), (4, "check_permission")], "symbol_id long, callee string")
    assert rows(syntax.open_routes(symbols, calls)) == [(2, "drop", "delete")]


def test_task_life_cycle():
    task = None
    seen = []
    for kind, text, n in [("ready", "e", 1), ("start", "x", 2), ("ready", "e", 1), ("done", "", 1), ("done", "", 3), ("poke", "", 0), ("done", "", 2), ("ready", "", 1), ("ready", "e", 90), ("gate", "failed", 0), ("poke", "", 0), ("poke", "", 0), ("start", "y", 0), ("ready", "e", 1), ("gate", "passed", 0), ("start", "z", 1)]:
        task, ok = session_stream.advance(task, kind, text, n, 2)
        seen.append((ok, task and task["status"], task and task["pokes"]))
    assert seen == [
        (False, None, None), (True, "active", 0), (False, "active", 0), (True, "active", 0), (False, "active", 0), (True, "active", 1), (True, "active", 1), (False, "active", 1), (True, "ready", 1),
        (True, "active", 1), (True, "active", 2), (True, "blocked", 2), (True, "active", 0), (True, "ready", 0), (True, "completed", 0), (True, "active", 0),
    ]


def test_pairs_of_names_are_made_once(spark):
    """Calls and symbols of one name are many pairs: none is shuffled after names have met, and ids that stand in several rows still count once."""
    symbols = spark.createDataFrame([(1, "f", "A"), (2, "f", "B"), (3, "f", None), (4, "g", "A"), (4, "f", "A"), (2, "f", "B")], "id long, name string, container string")
    calls = spark.createDataFrame([(9, "f", None), (9, "f", "A"), (8, "f", "A"), (8, "f", "A"), (8, "g", "A"), (7, "g", "B"), (6, None, None)], "symbol_id long, callee string, receiver string")
    made, back = graph.callees(calls, symbols), graph.callers(calls, symbols)
    assert rows(made) == [(8, 1), (8, 4), (9, 1), (9, 2), (9, 3), (9, 4)]
    assert rows(back) == [(1, 8, 2), (1, 9, 2), (2, 9, 2), (3, 8, 2), (3, 9, 2), (4, 8, 3), (4, 9, 2)]
    for df in (made, back):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        first = plan[: plan.index("_n#")] if "_n#" in plan else plan
        assert "Aggregate" not in first.split("Join")[0], plan
