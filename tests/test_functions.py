from pyspark.sql import functions as F

from graphloom.functions import files as fx
from graphloom.functions import text as tx


def column(spark, values, f):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("y")).collect()]


def test_tokenizer(spark):
    got = column(spark, ["validateToken", "token", "HTTPServerPool", "render_widget", "", "éTude"], tx.tokenize)
    assert got == [["validate", "token", "validatetoken"], ["token"], ["http", "server", "pool", "httpserverpool"], ["render", "widget"], [], ["é", "tude", "étude"]]


def test_module_stem(spark):
    names = ["./auth/session.ts", "crate::util", "os.path", "a\\b\\C.py", "pkg/ext1.js", "lib/.hidden.ts", "x.test.ts", "dir/x.test.ts", "  spaced/ "]
    assert column(spark, names, tx.module_stem) == ["session", "util", "path", "c", "ext1", ".hidden", "test", "x.test", "spaced"]


def test_urls_and_routes(spark):
    rows = [("/users/:id", "http://api/users/7", True), ("/users/{id}", "/users/7/x", False), ("/a/<b>", "https://h/A/z?q=1", True), ("/a", "b", False), ("/*", "/anything", True)]
    got = spark.createDataFrame(rows, "r string, u string, want boolean").withColumn("got", tx.segments_match(tx.route_segments(F.col("r")), tx.url_segments(F.col("u"))))
    assert all(r.got == r.want for r in got.collect())


def test_patterns():
    assert tx.like_of_wildcard("run_*") == "run\\_%" and tx.like_of_wildcard("gate") == "%gate%" and tx.like_of_glob("a?c") == "a_c"


def test_lines_and_domains(spark):
    assert column(spark, ["  a   b ", "// c", "import x", "", "use y", "package z", "x"], tx.normalized_line) == ["a b", None, None, None, None, None, "x"]
    assert column(spark, ["handleOrderUpdate", "computeTaxTotal2"], tx.domain_tokens) == [["order"], ["compute", "total2"]]


def test_truncation_and_names(spark):
    assert column(spark, ["abcdef", "abc"], lambda c: tx.truncated(c, 4)) == ["abcd…", "abc"]
    assert column(spark, ["unit tests"], tx.slug) == ["UNIT-TESTS"]
    assert column(spark, ["a.b.C", "std::vec<int>", "x"], tx.terminal_name) == ["C", "vec", "x"]
    assert column(spark, ["@deco\n# c\n  def f(x):\n pass"], tx.signature) == ["def f(x):"]


def test_file_predicates(spark):
    assert column(spark, ["a/target/x.rs", "src/x.rs"], fx.is_excluded) == [True, False]
    assert column(spark, ["a/Tests/x.rs", "x_test.go", "x.spec.ts", "src/x.rs"], fx.is_test) == [True, True, True, False]
    assert column(spark, ["a.pyi", "a.tsx", "Makefile", ".py", "a.hpp"], fx.language) == ["python", "javascript", None, None, "cpp"]
    assert column(spark, ["requirements-dev.txt", "x.csproj", "go.mod", "y.txt"], fx.is_manifest) == [True, True, True, False]
    assert column(spark, ["docs/a.md", "tests/a.md", "a.rs"], fx.is_documentation) == [True, False, False]
    assert column(spark, [".env.local", "Dockerfile", "a.conf", "a.rs"], fx.is_secret_text) == [True, True, True, False]
    assert column(spark, ["src/auth/guard.rs", "x/middlewarestack.rs", "src/routes/a.rs"], lambda c: fx.layer(tx.path_words(c))) == ["middleware", None, "routes"]


def test_brace_paths(spark):
    from graphloom.functions.sources import brace_paths, import_modules

    assert brace_paths("std::{fs::File, self, io::{Read, Write as W}, path}") == ["std::fs", "std", "std::io", "std::io", "std::path"]
    assert brace_paths("crate::util") == ["crate::util"] and brace_paths("a::*") == ["a"] and brace_paths("") == []
    got = spark.createDataFrame([("a::{b, c::D}",), (None,)], "x string").select(import_modules(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [["a::b", "a::c"], []]


def test_masked_scripts(spark):
    from graphloom.functions.sources import masked_scripts, script_only

    text = "<p>x</p>\n<script lang=\"ts\">\nlet a = 1\n</script>\n<i>"
    got = masked_scripts(text)
    assert len(got) == len(text) and got.split("\n")[2] == "let a = 1" and not got.replace("let a = 1", "").strip()
    assert masked_scripts("---\nconst b = 2\n---\n<p>", front=True).split("\n")[1] == "const b = 2"
    assert spark.createDataFrame([(text,), (None,)], "x string").select(script_only(F.col("x")).alias("y")).first().y == got
