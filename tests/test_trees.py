"""Ignore rules, digests of folders, and payloads, against plain Python."""

import hashlib
import json
import random
import re

from graphloom.operators import payloads, trees


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_ignored(path, rules):
    """Git's rules, folder by folder from the root; rules: folder -> lines."""

    def translate(p):
        out, i = "", 0
        while i < len(p):
            if p[i : i + 3] == "**/" and (i == 0 or p[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif p[i:] == "**" and i and p[i - 1] == "/":
                out, i = out + ".+", i + 2
            elif p[i] == "*":
                while p[i : i + 1] == "*":
                    i += 1
                out += "[^/]*"
            else:
                out += "[^/]" if p[i] == "?" else re.escape(p[i])
                i += 1
        return out

    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        entry, verdict = "/".join(parts[:n]), False
        for k in range(n):
            folder = "/".join(parts[:k])
            for line in rules.get(folder, []):
                p = line.rstrip(" ")
                if not p or p.startswith("#"):
                    continue
                negated = p.startswith("!")
                p = p[negated:]
                only = p.endswith("/")
                p = p.rstrip("/")
                if not p or only and n == len(parts):
                    continue
                rest = entry[len(folder) + 1 :] if folder else entry
                head = "" if "/" in p else "(?:.*/)?"
                if re.fullmatch(head + translate(p.removeprefix("/")), rest):
                    verdict = not negated
        if verdict:
            return True
    return False


def test_ignore_rules_match_plain_walk(spark):
    rng = random.Random(8)
    names = ["a", "b", "build", "log", "x.log", "y.py", "node_modules", "tmp"]
    patterns = ["*.log", "!x.log", "build/", "/a", "a/b", "**/tmp", "tmp/**", "a/**/log", "?", "!/b/", "# c", "", "y.*", "!y.py  ", "node_modules", "/*/build", "**/b/*.py"]
    for case in range(6):
        paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(120)})
        paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
        folders = ["", "a", "a/b", "b", "tmp"]
        rules = {f: [rng.choice(patterns) for _ in range(rng.randrange(5))] for f in folders}
        lines = spark.createDataFrame([(f, i, x) for f, ls in rules.items() for i, x in enumerate(ls)], "folder string, n int, line string")
        got = dict(rows(trees.ignored(spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "path string"), lines)))
        assert got == {p: plain_ignored(p, rules) for p in paths}, (case, rules)
    assert rows(trees.ignored(spark.createDataFrame([("a",)], "path string"), lines.limit(0))) == [("a", False)]


def test_digests_roll_up(spark):
    files = {"a/b/x": "1", "a/b/y": "2", "a/c/x": "1", "a/c/y": "2", "z": "3", "d/e/f/g": "4"}
    frame = lambda f: spark.createDataFrame(list(f.items()), "path string, content_hash string")

    def plain(f, folder=""):
        kids = {}
        for p, h in f.items():
            head, _, rest = p.partition("/")
            kids.setdefault(head, {})[rest] = h
        lines, out = [], {}
        for name, below in kids.items():
            at = f"{folder}/{name}" if folder else name
            if list(below) == [""]:
                out[at] = (below[""], False)
            else:
                out |= plain(below, at)
            lines.append(f"{name}\t{'d' if out[at][1] else 'f'}\t{out[at][0]}")
        out[folder] = (hashlib.md5("\n".join(sorted(lines)).encode()).hexdigest(), True)
        return out

    made = trees.digests(frame(files))
    assert {r.path: (r.digest, r.is_folder) for r in made.collect()} == plain(files)
    got = {r.path: r.digest for r in made.collect()}
    assert got["a/b"] == got["a/c"] != got["a"]
    later = {**{k: v for k, v in files.items() if not k.startswith("d/")}, "a/c/y": "9", "n/m": "1"}
    moved = trees.changed_subtrees(trees.digests(frame(later)), made)
    assert rows(moved) == [("", True, "changed"), ("a", True, "changed"), ("a/c", True, "changed"), ("a/c/y", False, "changed"), ("d", True, "gone"), ("n", True, "new")]
    assert trees.digests(frame(files).limit(0)).count() == 0 and trees.changed_subtrees(made, made).count() == 0


def test_fingerprints_change_with_what_they_are_of(spark):
    files = spark.createDataFrame([("package.json", "1"), ("src/a.py", "2"), ("go.mod", None)], "path string, content_hash string")
    status = spark.createDataFrame([("src/a.py", "M"), ("new", "??")], "path string, state string")
    one = lambda df: df.first().fingerprint
    first = one(trees.worktree_fingerprint(status, files))
    assert first == one(trees.worktree_fingerprint(status.orderBy("path"), files)) and one(trees.worktree_fingerprint(status.limit(0), files)) is None
    edited = spark.createDataFrame([("package.json", "1"), ("src/a.py", "3"), ("go.mod", None)], "path string, content_hash string")
    assert one(trees.worktree_fingerprint(status, edited)) != first
    assert one(trees.dependency_fingerprint(files, "npm ci")) == one(trees.dependency_fingerprint(edited, "npm ci")) != one(trees.dependency_fingerprint(files, "npm i"))
    tasks = spark.createDataFrame([("a", None), ("a", ""), ("a", "b")], "goal string, scope string")
    assert len({r.fingerprint for r in trees.task_fingerprints(tasks, ("goal", "scope")).collect()}) == 3


def test_payloads_at_any_depth(spark):
    def plain(v, name, path):
        if isinstance(v, dict):
            return [x for k, c in v.items() for x in plain(c, k, f"{path}.{k}")]
        if isinstance(v, list):
            return [x for i, c in enumerate(v) for x in plain(c, name, f"{path}[{i}]")]
        return [(path, name, v)]

    rng = random.Random(3)

    def grow(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["text", "http://h", "", "a b"])
        if kind < 0.6:
            return [grow(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["url", "path", "Files", "table", "k", "env"]): grow(depth - 1) for _ in range(rng.randrange(4))}

    docs = {i: grow(7) for i in range(60)}
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(100, "nope"), (101, None), (102, "{}")], "event_id long, payload string")
    got = sorted((r.event_id, r.path, r.name or "", r.value) for r in payloads.leaves(frame).collect())
    assert got == sorted((i, p, n or "", v) for i, d in docs.items() for p, n, v in plain(d, None, "$"))
    tools = spark.createDataFrame([(1, '{"tool_name":"mcp__a__b","tool_input":{"x":[{"URL":" h "},{"files":["a.py","b.py"]}],"db":"d\\nd","n":1,"table":""}}'), (2, '{"toolCall":{"name":"Edit","args":{"er":[[["q",{"path":"p"}]]]}}}')], "event_id long, payload string")
    assert rows(payloads.resources(tools)) == [(1, "mcp:a/b"), (1, "url:h"), (2, "tool:Edit")]
    assert rows(payloads.paths(tools)) == [(1, "a.py"), (1, "b.py"), (2, "p")]


def test_levels_are_opened_without_writing(spark, monkeypatch):
    """Payloads of a few levels are written nowhere on the way; deeper ones only as what is left below."""
    from graphloom.operators import payloads

    cut, writes = payloads._cut, []
    monkeypatch.setattr(payloads, "_cut", lambda df: writes.append(1) or cut(df))
    frame = lambda text: spark.createDataFrame([(1, text), (2, None), (3, "[[], {}, [null]]"), (4, "no {")], "event_id long, payload string")
    got = lambda text: sorted((r.event_id, r.path, r.name, r.value, r.kind) for r in payloads.leaves(frame(text)).collect())
    assert got('{"a": [1, {"b": "x"}], "c": {}}') == [(1, "$.a[0]", "a", "1", "bigint"), (1, "$.a[1].b", "b", "x", "string"), (3, "$[2][0]", None, None, "void")] and not writes
    deep = '{"a":' * (payloads.LEVELS + 3) + "true" + "}" * (payloads.LEVELS + 3)
    assert got(deep)[0] == (1, "$" + ".a" * (payloads.LEVELS + 3), "a", "true", "boolean") and len(writes) == 1
