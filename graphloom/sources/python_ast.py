"""Syntax nodes and statements of Python sources, by the standard library's parser inside tasks.

A task says what stands in one file and nothing more: who calls what, which routes
and receivers there are and which functions are alike is settled by joins, in
``operators.extraction`` and ``operators.summaries``. A file that can't be parsed,
whatever the reason, is one node of kind error and has no statements. Other
languages enter as tables of the same schemas that a user brings.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "file_id long, node_id long, parent_id long, kind string, name string, pre long, post long, start_line long, end_line long, size long, text string, "
    "depth long, function_id long, parent_kind string, bounded boolean, holds_loop boolean, "
    # calls: what stands before the name, the first argument and the first address if they are stated, named arguments, the first of methods=, the function that it decorates;
    # assignments: the one name that is given the value of a call; classes: bases; functions: parameters, and their code as tokens, of which names begin with a mark
    "qualifier string, literal string, url string, named array<string>, verb string, owner_id long, target string, value string, character long, form array<string>"
)
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
#: Kinds of nodes that are kept; what lies between them is left out.
_KINDS = {
    ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.If: "branch",
    ast.IfExp: "branch", ast.BoolOp: "branch", ast.ExceptHandler: "handler", ast.Call: "call", ast.List: "literal", ast.Dict: "literal", ast.Set: "literal", ast.Tuple: "literal", ast.Assign: "assign",
    ast.Return: "return", ast.match_case: "branch", ast.keyword: "keyword", ast.Import: "import", ast.ImportFrom: "import",
}
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: What marks a name in the form of a function.
NAME_MARK = "\x01"


class _Text:
    """The source of each node."""

    def __init__(self, text: str) -> None:
        self.raw = text.encode()
        self.lines = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", self.raw))]

    def of(self, node: ast.AST) -> str:
        if getattr(node, "end_lineno", None) is None or not hasattr(node, "col_offset"):
            return ""
        a, b = self.lines[node.lineno - 1] + node.col_offset, self.lines[node.end_lineno - 1] + node.end_col_offset
        return " ".join(self.raw[a:b].decode("utf-8", "replace").split())

    def line(self, number: int) -> str:
        a = self.lines[number - 1]
        b = self.lines[number] if number < len(self.lines) else len(self.raw)
        return self.raw[a:b].decode("utf-8", "replace").strip()

    def dotted(self, node: ast.AST) -> str:
        """The name of what is called: names with points between, on whatever they begin with."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        parts.append(node.id if isinstance(node, ast.Name) else self.of(node))
        return ".".join(reversed(parts))


class _Each:
    """One `for` of a comprehension: it holds its conditions and the next `for`, or in the end the elements."""

    def __init__(self, generators: list, elements: list, place: ast.AST) -> None:
        self.iter, self.target, self.ifs = generators[0].iter, generators[0].target, generators[0].ifs
        self.rest = [_Each(generators[1:], elements, place)] if generators[1:] else elements
        self.lineno, self.end_lineno = place.lineno, place.end_lineno


def _parts(node) -> tuple[list, list, list]:
    """What is evaluated before a node's own part, within it, and after: a loop's iterable and else, a function's decorators and defaults are not within."""
    if isinstance(node, _Each):
        return [node.iter], [node.target, *node.ifs, *node.rest], []
    if isinstance(node, _COMPREHENSIONS):
        elements = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
        return [], [_Each(node.generators, elements, node)], []
    if isinstance(node, (ast.For, ast.AsyncFor)):
        return [node.iter], [node.target, *node.body], node.orelse
    if isinstance(node, ast.While):
        return [], [node.test, *node.body], node.orelse
    if isinstance(node, _FUNCTIONS):
        return [*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d)], node.body, []
    if isinstance(node, ast.ClassDef):
        return [*node.decorator_list, *node.bases, *node.keywords], node.body, []
    return [], list(ast.iter_child_nodes(node)), []


def _name(node, text: _Text) -> str:
    if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
        return node.name
    if isinstance(node, ast.Call):
        return text.dotted(node.func)
    if isinstance(node, ast.keyword):
        return node.arg or ""
    if isinstance(node, ast.ExceptHandler):
        empty = all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in node.body)
        return "empty" if empty else ""
    return ""


def _stated(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _details(node, text: _Text) -> dict:
    """The columns that only some kinds have."""
    if isinstance(node, ast.Call):
        given = [*node.args[1:], *(k.value for k in node.keywords if k.arg in ("view_func", "handler", "endpoint"))]
        methods = [e for k in node.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple, ast.Set)) for e in k.value.elts]
        urls = [u for u in map(_stated, node.args) if u and ("://" in u or u.startswith("/"))]
        return {
            "qualifier": text.dotted(node.func.value) if isinstance(node.func, ast.Attribute) else None, "literal": _stated(node.args[0]) if node.args else None, "url": urls[0] if urls else None,
            "named": [text.dotted(x) for x in given if isinstance(x, (ast.Name, ast.Attribute))], "verb": next((v for v in map(_stated, methods) if v), None),
        }
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
        return {"target": node.targets[0].id, "value": text.dotted(node.value.func) if isinstance(node.value, ast.Call) else None}
    if isinstance(node, ast.ClassDef):
        return {"named": [text.dotted(b) for b in node.bases]}
    if isinstance(node, _FUNCTIONS):
        return {"named": _parameters(node), "form": _form(node)}
    return {}


def _parameters(f) -> list[str]:
    a = f.args
    return [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]


def _form(f) -> list[str]:
    """A function's parameters and body as tokens in order: kinds of nodes, numbers of children, literals, and names with a mark."""
    out: list[str] = []
    stack: list = [*reversed(f.body), f.args]
    while stack:
        x = stack.pop()
        if isinstance(x, ast.Name):
            out.append(NAME_MARK + x.id)
        elif isinstance(x, ast.arg):
            out.append(NAME_MARK + x.arg)
        elif isinstance(x, ast.AST):
            out.append(type(x).__name__)
            stack.extend(v for k, v in reversed(list(ast.iter_fields(x))) if k not in ("ctx", "type_comment", "kind"))
        elif isinstance(x, list):
            out.append(f"[{len(x)}")
            stack.extend(reversed(x))
        else:
            out.append(repr(x))
    return out


def _bounded(node) -> bool:
    """Whether a loop runs over a range of stated numbers."""
    over = getattr(node, "iter", None)
    return isinstance(over, ast.Call) and isinstance(over.func, ast.Name) and over.func.id == "range" and bool(over.args) and all(isinstance(a, ast.Constant) and isinstance(a.value, int) for a in over.args)


def _error(file_id: int, e: BaseException) -> dict:
    line = getattr(e, "lineno", None) or 1
    plain = {"file_id": file_id, "node_id": 0, "kind": "error", "name": type(e).__name__, "pre": 0, "post": 1, "start_line": line, "end_line": line, "size": 0, "text": "", "depth": 0}
    return plain | {"bounded": False, "holds_loop": False}


def read(file_id: int, source: str) -> tuple[list[dict], list[dict]]:
    """(nodes, statements) of one source; one that can't be read for any reason is one node of kind error."""
    try:
        tree, text = ast.parse(source), _Text(source)
        return node_rows(file_id, tree, text), statement_rows(file_id, tree, text)
    except (Exception, RecursionError, MemoryError) as e:  # whatever one file does, the others are read
        return [_error(file_id, e)], []


def node_rows(file_id: int, tree: ast.Module, text: _Text) -> list[dict]:
    """Nodes of one source in the order of entering.

    depth is how many loops hold a node, function_id its innermost function, parent_kind the kind of the node that holds it.
    """
    rows: list[list] = []
    details: dict[int, dict] = {}
    placed: dict[int, int] = {}
    clock, last_loop = 0, -1
    # (node, its holder, loops around it, innermost function), or (None, the node that ends)
    stack: list[tuple] = [(tree, None, 0, None)]
    while stack:
        node, parent, depth, function = stack.pop()
        if node is None:
            rows[parent][6], rows[parent][15] = clock, last_loop > parent
            clock += 1
            continue
        if isinstance(node, tuple):  # the own part of a node, after what is before it
            node, within = node
            kind = "loop" if isinstance(node, _Each) else _KINDS[type(node)]
            at = len(rows)
            start = getattr(node, "lineno", None) or (rows[parent][7] if parent is not None else 1)
            end = getattr(node, "end_lineno", None) or start
            code = text.of(node) if kind in ("call", "assign", "return", "keyword") else text.line(start)[:200] if kind in ("function", "class") else ""
            over = rows[parent][3] if parent is not None else None
            rows.append([file_id, at, parent, kind, _name(node, text), clock, 0, start, end, len(within), code, depth, function, over, kind == "loop" and _bounded(node), False])
            details[at] = _details(node, text) | {"character": getattr(node, "col_offset", None)}
            if isinstance(node, ast.Call):
                placed[id(node)] = at
            elif kind == "function":
                for d in node.decorator_list:
                    if id(d) in placed:
                        details[placed[id(d)]]["owner_id"] = at
            clock += 1
            if kind == "loop":
                last_loop, depth = at, depth + 1
            if kind == "function":
                function, depth = at, 0
            stack.append((None, at, 0, None))
            stack.extend((child, at, depth, function) for child in reversed(within))
            continue
        before, within, after = _parts(node)
        stack.extend((child, parent, depth, function) for child in reversed(after))
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [node.module] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names]
            for name in filter(None, names):
                rows.append([file_id, len(rows), parent, "import", name, clock, clock + 1, node.lineno, node.end_lineno, 0, "", depth, function, rows[parent][3] if parent is not None else None, False, False])
                clock += 2
        elif isinstance(node, _Each) or type(node) in _KINDS:
            stack.append(((node, within), parent, depth, function))
        else:
            stack.extend((child, parent, depth, function) for child in reversed(within))
        stack.extend((child, parent, depth, function) for child in reversed(before))
    return [dict(zip(_COLUMNS, r)) | details.get(r[1], {}) for r in rows]


def _own(statements: list) -> list[ast.AST]:
    """All nodes of statements but those of functions and classes defined in them, of which decorators and defaults count."""
    found, stack = [], list(reversed(statements))
    while stack:
        node = stack.pop()
        found.append(node)
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            inner = _parts(node)[0]
        elif isinstance(node, _COMPREHENSIONS):  # what it runs over comes before its elements
            inner = [*node.generators, *([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])]
        else:
            inner = list(ast.iter_child_nodes(node))
        stack.extend(reversed(inner))
    return found


STATEMENTS = (
    "file_id long, function_id long, function string, seq long, line long, end_line long, kind string, target string, uses array<string>, calls array<string>, sink string, evidence string, "
    "place int, call long, direct array<string>, outer array<long>"
)


def _taken(nodes: list[ast.AST], text: _Text) -> tuple[list[str], list[str], list[str], list[ast.AST]]:
    """(names and dotted names, called names) of expressions, once each in order; (those outside of any call, the calls that no other call holds)."""
    inside = [n for x in nodes for n in ast.walk(x)]
    named = lambda found: [n.id for n in found if isinstance(n, ast.Name)] + [text.dotted(n) for n in found if isinstance(n, ast.Attribute)]
    calls = [n for n in inside if isinstance(n, ast.Call)]
    plain, outer, stack = [], [], list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, ast.Call):
            outer.append(n)
        else:
            plain.append(n)
            stack.extend(ast.iter_child_nodes(n))
    return list(dict.fromkeys(named(inside))), list(dict.fromkeys(text.dotted(n.func) for n in calls)), list(dict.fromkeys(named(plain))), outer


def _names(target: ast.AST) -> list[str]:
    return [n.id for n in ast.walk(target) if isinstance(n, ast.Name)]


def _functions(tree: ast.Module) -> list[tuple[int, ast.AST]]:
    """(how deep it stands in the tree, function) in the order of ast.walk."""
    found, level, depth = [], [tree], 0
    while level:
        found += [(depth, n) for n in level if isinstance(n, _FUNCTIONS)]
        level, depth = [c for n in level for c in ast.iter_child_nodes(n)], depth + 1
    return found


def statement_parts(tree: ast.Module, text: _Text) -> list[tuple[int, str, list[dict], int]]:
    """(depth, name, rows, number of calls) of the module, then of each function: STATEMENTS but for what counts through the source; calls are numbered from 0 in each."""
    parts = []
    for depth, name, parameters, body in [(0, "", [], tree.body), *((d, f.name, _parameters(f), f.body) for d, f in _functions(tree))]:
        rows: list[dict] = []
        numbers: dict[int, int] = {}

        def add(node, kind: str, target: str | None, taken: list[ast.AST], sink: str | None = None, evidence: str = "", place: int | None = None, call: int | None = None, rows: list = rows, numbers: dict = numbers) -> None:
            uses, calls, direct, outer = _taken(taken, text)
            line = getattr(node, "lineno", 1)
            end_line = getattr(node, "end_lineno", None) or line
            outer = [numbers.setdefault(id(n), len(numbers)) for n in outer]
            rows.append({"line": line, "end_line": end_line, "kind": kind, "target": target, "uses": uses, "calls": calls, "sink": sink, "evidence": evidence, "place": place, "call": call, "direct": direct, "outer": outer})

        if depth:
            add(body[0], "define", None, [])
        for i, p in enumerate(parameters):
            add(body[0], "parameter", p, [], place=i)
        for node in _own(body):
            if isinstance(node, ast.Call):
                number = numbers.setdefault(id(node), len(numbers))
                called = text.dotted(node.func)
                add(node, "site", None, [], called, call=number)
                if isinstance(node.func, ast.Attribute):
                    add(node, "argument", None, [node.func.value], called, place=-1, call=number)
                for i, x in enumerate(node.args):
                    add(node, "argument", None, [x], called, place=i, call=number)
                for x in node.keywords:
                    add(node, "argument", x.arg, [x.value], called, call=number)
                first = node.args[0] if node.args else node.keywords[0].value if node.keywords else None
                if first is not None and not isinstance(first, ast.Constant):
                    add(node, "call", None, [first], called, text.of(node), call=number)
                if isinstance(node.func, ast.Attribute) and node.func.attr in ("append", "add", "insert", "extend", "update"):
                    for t in _names(node.func.value)[:1]:
                        add(node, "add", t, [*node.args])
            elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)) and node.value is not None:
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Attribute):
                        add(node, "call", None, [node.value], text.dotted(target), text.of(node))
                    for t in _names(target)[:1] if isinstance(target, (ast.Attribute, ast.Subscript)) else _names(target):
                        add(node, "add" if isinstance(target, (ast.Attribute, ast.Subscript)) or isinstance(node, ast.AugAssign) else "assign", t, [node.value])
            elif isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension)):
                for t in _names(node.target):
                    add(node.iter, "assign", t, [node.iter])
            elif isinstance(node, ast.withitem) and node.optional_vars is not None:
                for t in _names(node.optional_vars):
                    add(node.context_expr, "assign", t, [node.context_expr])
            elif isinstance(node, ast.Return) and node.value is not None:
                add(node, "return", None, [node.value])
        parts.append((depth, name, rows, len(numbers)))
    return parts


def statement_rows(file_id: int, tree: ast.Module, text: _Text) -> list[dict]:
    """What functions and the module do with names, in order: their parameters, assignments, additions to collections, calls and returns.

    uses and calls are all of an expression's, direct those outside of its calls, and outer numbers the calls that give it values. A call is a row of kind site;
    its arguments are rows with their places (what it is a method of: -1, what is given by name: the name as target); one of kind call, if it is given more than a
    literal, has the uses of its first argument. function_id is the function's place among the functions of the source, -1 for the module; a function is a row of kind define.
    """
    out: list[dict] = []
    calls = 0
    for k, (_, name, rows, n) in enumerate(statement_parts(tree, text), -1):
        for r in rows:
            call = None if r["call"] is None else r["call"] + calls
            out.append({"file_id": file_id, "function_id": k, "function": name, "seq": len(out)} | r | {"call": call, "outer": [c + calls for c in r["outer"]]})
        calls += n
    return out


def _struct(columns: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in columns.split(", ")))


def _chosen(schema: str, columns: tuple[str, ...] | None) -> str:
    return schema if columns is None else ", ".join(c for c in schema.split(", ") if c.split()[0] in ("file_id", *columns))


#: Sources that are read at once.
AT_ONCE = 500


def parsed(
    sources: DataFrame, of_nodes: tuple[str, ...] | None = None, of_statements: tuple[str, ...] | None = None, node_kinds: tuple[str, ...] | None = None, statement_kinds: tuple[str, ...] | None = None
) -> DataFrame:
    """(file_id, nodes, statements): all of each source (file_id, text), each read once; the columns and kinds that are named, if any are. Write it if both are used."""
    node_columns, statement_columns = _chosen(NODES, of_nodes), _chosen(STATEMENTS, of_statements)
    schema = f"file_id long, nodes array<struct<{_struct(node_columns)}>>, statements array<struct<{_struct(statement_columns)}>>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.sources.pieces import Reader

        reader = Reader()
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                ids = batch.column(0).slice(a, AT_ONCE)
                made = reader.batch(ids.to_pylist(), batch.column(1).slice(a, AT_ONCE).to_pylist())
                lists = []
                for rows, columns, kinds in ((made.nodes, node_columns, node_kinds), (made.statements, statement_columns, statement_kinds)):
                    names = [c.split()[0] for c in columns.split(", ")]
                    arrays, source = rows(names, kinds)
                    ends = np.searchsorted(source, np.arange(len(ids) + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, names)))
                yield pa.RecordBatch.from_arrays([ids, *lists], ["file_id", "nodes", "statements"])

    return sources.select(F.col("file_id").cast("long"), "text").mapInArrow(parse, schema)


def _rows(sources: DataFrame, what: str, schema: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """Nodes or statements alone, as rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.sources.pieces import Reader

        reader = Reader(what == "nodes", what == "statements")
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                made = reader.batch(batch.column(0).slice(a, AT_ONCE).to_pylist(), batch.column(1).slice(a, AT_ONCE).to_pylist())
                yield pa.RecordBatch.from_arrays(getattr(made, what)(names, kinds)[0], names)

    return sources.select(F.col("file_id").cast("long"), "text").mapInArrow(parse, schema)


def _of(sources: DataFrame, what: str, schema: str, kinds: tuple[str, ...] | None, columns: tuple[str, ...] | None) -> DataFrame:
    schema = _chosen(schema, columns)
    if what not in sources.columns:
        return _rows(sources, what, schema, kinds)
    held = sources.select(F.inline(what)).select(*[c.split()[0] for c in schema.split(", ") if columns is not None] or ["*"])
    return held if kinds is None else held.where(F.col("kind").isin(*kinds))


def nodes(sources: DataFrame, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes of all sources (file_id, text), or of what parsed() made of them: of these kinds and columns (file_id always), if any are named."""
    return _of(sources, "nodes", NODES, kinds, columns)


def statements(sources: DataFrame, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """STATEMENTS of all sources (file_id, text), or of what parsed() made of them: of these kinds and columns (file_id always), if any are named."""
    return _of(sources, "statements", STATEMENTS, kinds, columns)
