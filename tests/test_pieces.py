"""Sources read by pieces against the same sources read whole."""

import ast
import random

import pytest

from graphloom.sources import pieces, python_ast
from graphloom.sources.adapter import LINKED, STATEMENTS

NODES, STATEMENT = ([c.split()[0] for c in x.split(", ")] for x in (python_ast.NODES, python_ast.STATEMENTS))

ODD = (
    "", None, "\n\n", "x", "def f(:", "\tx=1", "def f(x):\n\ty(1)\n", "x = 'a\x00'", "# c\n", "def f(x):\n    # only\n", "def f(x): return g(x)\ndef h():\n    pass", "é = f('ü')\ndef g(ä):\n    return ä.b(é)\n",
    "def f(a):\n    x = 1 \\\n    y = 2\n", "def f(a):\n    return '''\n    b = 1\n'''\n", "def f(a):\n    x = (1,\n    2)\n    y = g(x)\n", "def f(a):\n    if a:\n        b()\n    elif c:\n        d()\n    else:\n        e()\n    for x in y: z(x)\n    else:\n        w()\n",
    "@deco(1, x=f(2))\ndef g(a=h(1)):\n    return a(lambda: k(3))\n", "x = [\n1,\n]\nif a:\n    b()\nelse:\n    c()\n", "class K(B):\n    def m(self):\n        def n(): q(1)\n        return n()\n", "def f(a):\n    match a:\n        case 1:\n            y()\n", "def if(x):\n    a\n",
    "def f(a):\n    x = 1\n# d\n    y = load(z(1), a)\n", "def w(a):\n  for b in a:\n    def v(): u(b)\n    def vv(): u(b)\n  t(1)\n  while c(): d()\ndef x(b):\n  def y():\n    def z(): c(1)\n    z(2)\n  y(e(f))\n", "def f(a, a):\n    'd'\n    'e'\n    a\n", "def f(a):\r\n    b(a)\r\n", "def f(a):\n  x\n    y\n",
)


def made(of, columns, texts, step):
    reader, out = pieces.Reader(), []
    for a in range(0, len(texts), step):
        batch = reader.batch(list(range(a, a + len(texts[a : a + step]))), texts[a : a + step])
        out += list(zip(*[x.to_pylist() for x in getattr(batch, of)(columns)[0]], strict=True))
    return out


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_pieces_are_the_whole(step):
    r = random.Random(step)
    head = lambda i: f"def report_{i}_{r.randrange(9)}({r.choice(['', 'xs', 'xs, cfg', 'self, *a', 'a, *, b', 'a,'])}):\n    total = []\n"
    body = lambda: "".join(r.choice(STATEMENTS).text for _ in range(r.randrange(9)))
    varied = ["import requests\n" * (i % 2) + head(i) + body() + "    return total\n" + r.choice([x or "" for x in ODD]) + head(i) + body() + r.choice(["    return (\n", "    return 1"]) for i in range(120)]
    texts = [*ODD, *varied, *[f"def step_{i}(x, other=None):\n{t}" for i, t in enumerate(LINKED)], open(python_ast.__file__).read()]
    whole = [python_ast.read(i, t or "") for i, t in enumerate(texts)]
    assert made("nodes", NODES, texts, step) == [tuple(x.get(c) for c in NODES) for n, _ in whole for x in n]
    assert made("statements", STATEMENT, texts, step) == [tuple(x[c] for c in STATEMENT) for _, s in whole for x in s]


def test_equal_pieces_are_read_once(monkeypatch):
    """Sources that differ in their functions' names and in the order of statements are no reason to parse each statement again."""
    r, parse, read = random.Random(1), ast.parse, []
    monkeypatch.setattr(ast, "parse", lambda *a: read.append(a[0]) or parse(*a))
    texts = [f"def f{i}(xs):\n" + "".join(r.choice(STATEMENTS).text for _ in range(20)) for i in range(300)]
    batch = pieces.Reader(True, False).batch(list(range(300)), texts)
    kinds = batch.nodes(["kind", "name"], ("function",))[0]
    assert kinds[1].to_pylist()[::50] and len(read) < 60


def test_chosen_kinds_and_columns(spark):
    held = spark.createDataFrame([(1, "import a\ndef f(x):\n    for y in x:\n        g(y)\n"), (2, "def (")], "file_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for given in (held, python_ast.parsed(held)):
        assert rows(python_ast.nodes(given, ("loop", "error"), ("kind", "start_line"))) == [(1, "loop", 3), (2, "error", 1)]
        assert rows(python_ast.statements(given, ("define",), ("function", "line"))) == [(1, "f", 3)]
    assert python_ast.nodes(held).columns == NODES and python_ast.parsed(held, ("name",), ("kind",)).select("nodes.name", "statements.kind").count() == 2
