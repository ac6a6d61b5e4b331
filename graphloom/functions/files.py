"""Predicates and classes of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that are never read (fixed values).
EXCLUDED_PARTS = (".git", "node_modules", "target", "dist", "build", "coverage", "vendor", ".next", ".turbo")
#: Folders of tests (fixed values).
TEST_PARTS = ("test", "tests", "__tests__")
#: Folders of tests and what they read (fixed values).
FIXTURE_PARTS = ("test", "tests", "__tests__", "spec", "specs", "fixtures", "testdata")
#: Endings of documentation (fixed values).
DOCUMENTATION_ENDINGS = ("md", "markdown", "txt", "rst", "adoc")
#: Endings of sources whose lines no test covers (fixed values).
MARKUP_ENDINGS = ("html", "htm", "css", "json", "yaml", "yml", "toml", "md", "markdown", "mk")
#: Endings of texts that may hold secrets (fixed values).
SECRET_ENDINGS = ("yaml", "yml", "json", "toml", "ini", "conf", "properties")
#: Families of languages and their endings (fixed values).
LANGUAGES = {
    "javascript": ("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx"), "rust": ("rs",), "go": ("go",), "python": ("py", "pyi"), "java": ("java",),
    "kotlin": ("kt", "kts"), "csharp": ("cs",), "c": ("c",), "cpp": ("cpp", "cc", "cxx", "h", "hpp"), "ruby": ("rb",), "php": ("php",), "swift": ("swift",),
    "dart": ("dart",), "shell": ("sh", "bash", "zsh"), "zig": ("zig",), "lua": ("lua",), "scala": ("scala", "sc"), "solidity": ("sol",), "elixir": ("ex", "exs"),
    "erlang": ("erl", "hrl"), "r": ("r",), "hcl": ("tf", "hcl"), "html": ("html", "htm"), "css": ("css",), "json": ("json",), "yaml": ("yaml", "yml"), "toml": ("toml",),
    "markdown": ("md", "markdown"), "ocaml": ("ml",), "haskell": ("hs",), "julia": ("jl",), "perl": ("pl", "pm"), "groovy": ("groovy", "gradle"), "objc": ("m", "mm"),
    "verilog": ("v", "sv", "svh"), "svelte": ("svelte",), "make": ("mk",),
}
#: Endings that are scanned without a language of their own (fixed values).
OTHER_SOURCES = ("sql", "astro", "fish", "vue", "proto")
#: Names of package manifests and locks (fixed values).
MANIFESTS = (
    "Cargo.toml", "Cargo.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "pyproject.toml", "poetry.lock", "uv.lock", "go.mod", "go.sum",
    "pom.xml", "build.gradle", "build.gradle.kts", "gradle.lockfile", "Package.swift", "Package.resolved", "pubspec.yaml", "pubspec.lock", "Gemfile", "Gemfile.lock", "composer.json",
    "composer.lock", "packages.lock.json", "Directory.Packages.props", "mix.exs", "mix.lock", "rebar.config", "rebar.lock", "deps.edn", "project.clj",
)
#: Layers by words of paths, the first that fits (fixed values).
LAYERS = (
    ("routes", ("route", "router", "endpoint")),
    ("controllers", ("controller", "handler")),
    ("services", ("service", "usecase", "domain")),
    ("repositories", ("repository", "repo", "dao", "store")),
    ("database", ("migration", "schema", "model", "entity", "query")),
    ("middleware", ("middleware", "interceptor", "guard")),
    ("config", ("config", "settings", "env")),
    ("cli", ("cli", "cmd", "main", "bin")),
)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ending(path: Column) -> Column:
    """What follows the last dot of the file's name; empty without one, or if the name only begins with it."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def _has_part(path: Column, parts: tuple[str, ...], lower: bool = True) -> Column:
    return F.arrays_overlap(F.split(F.lower(path) if lower else path, "/"), F.array(*[F.lit(p) for p in parts]))


def is_excluded(path: Column) -> Column:
    return _has_part(path, EXCLUDED_PARTS, False)


def is_test(path: Column) -> Column:
    name = F.lower(file_name(path))
    return _has_part(path, TEST_PARTS) | name.endswith("_test.go") | name.endswith("_test.rs") | name.contains(".test.") | name.contains(".spec.")


def language(path: Column) -> Column:
    """The language family of a path; null if it has none."""
    families = F.create_map(*[F.lit(x) for family, endings in LANGUAGES.items() for e in endings for x in (e, family)])
    return F.try_element_at(families, ending(path))


def is_source(path: Column) -> Column:
    return language(path).isNotNull() | ending(path).isin(*OTHER_SOURCES)


def is_coverable(path: Column) -> Column:
    return is_source(path) & ~ending(path).isin(*MARKUP_ENDINGS)


def is_secret_text(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (name == "dockerfile") | name.startswith(".env") | F.lower(ending(path)).isin(*SECRET_ENDINGS)


def is_manifest(path: Column) -> Column:
    name = file_name(path)
    return name.isin(*MANIFESTS) | name.rlike(r"^requirements.*\.txt$") | name.endswith(".csproj")


def is_documentation(path: Column) -> Column:
    return ~_has_part(path, FIXTURE_PARTS) & F.lower(ending(path)).isin(*DOCUMENTATION_ENDINGS)


def layer(words: Column) -> Column:
    """The first layer with a keyword, singular or plural, among the words of a path."""
    out = F.lit(None).cast("string")
    for name, keywords in reversed(LAYERS):
        both = [F.lit(k + s) for k in keywords for s in ("", "s")]
        out = F.when(F.arrays_overlap(words, F.array(*both)), F.lit(name)).otherwise(out)
    return out
