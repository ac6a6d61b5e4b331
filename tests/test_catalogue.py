"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal

import duckdb
import pytest

from graphloom import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    made = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in made.fetchall()), key=repr)


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0


def test_task_states_match_a_fold(spark):
    """The stream against the same rules folded over the whole table at once."""
    from graphloom.streaming.session import advance

    kinds = {"signup": "start", "click": "done", "view": "ready", "purchase": "gate", "error": "poke"}
    tasks, want = {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        kind, v = kinds[r.event_type], int(r.value // 1)
        n = v % 3 if kind == "start" else v % 3 + 1 if kind == "done" else v % 101
        text = "passed" if kind == "gate" else f"objective {v % 3}"
        tasks[r.user_id], ok = advance(tasks.get(r.user_id), kind, text, n)
        want[r.event_id] = (ok, tasks[r.user_id] and tasks[r.user_id]["status"])
    got = {r.event_id: (r.accepted, r.status) for r in catalogue.queries()["task_states"](spark, SF).collect()}
    assert got == want and {s for _, s in want.values()} >= {"active", "ready", "completed"}


def test_whole_tables_match_brute_force(spark):
    """The queries on closures against a walk in Python."""
    from graphloom.sources.adapter import Graph

    g = Graph(spark, SF)
    symbols = g.symbols.select("id", "name", "route_path").collect()
    name = {r.id: r.name for r in symbols}
    callers = {}
    for r in g.calls.select("symbol_id", "callee").distinct().collect():
        if r.symbol_id in name:
            callers.setdefault(r.callee, set()).add(name[r.symbol_id])

    found = {"small ring"} if "small ring" in name.values() or "small ring" in callers else set()
    front = set(found)
    while front:
        front = {c for f in front for c in callers.get(f, ())} - found
        found |= front
    assert found and {r.name for r in catalogue.queries()["call_closure"](spark, SF).collect()} == found

    files = g.files.select("id", "path", "stem", "size").collect()
    changed = {f.path for f in files if f.size < 0}
    users = {}
    for r in g.imports.select("file_id", "stem").collect():
        users.setdefault(r.stem, set()).add(r.file_id)
    hit = {u for f in files if f.path in changed for u in users.get(f.stem, ()) if u != f.id}
    assert sorted(r.path for r in catalogue.queries()["affected_files"](spark, SF).collect()) == sorted(f.path for f in files if f.id in hit and f.path not in changed)
