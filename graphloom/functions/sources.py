"""Functions on source text that need a parser's state: nested import braces, script blocks of component files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
_FRONT = re.compile(r"\A---\r?\n(.*?)^---\s*$", re.DOTALL | re.MULTILINE)


def _parts(inside: str) -> list[str]:
    """Items of a list at its own level: commas within braces do not part it."""
    out, depth, item = [], 0, ""
    for c in inside:
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            out.append(item.strip())
            item = ""
        else:
            item += c
    return [x for x in (*out, item.strip()) if x]


def brace_paths(path: str) -> list[str]:
    """The modules of an import with nested braces: a::{b::C, self, d::{e}} names a::b, a and a::d::e.

    A last part in capitals, or a star, is an item of its module. Renames are dropped.
    """
    todo, out = [("", path.strip())], []
    while todo:
        prefix, rest = todo.pop()
        head, brace, tail = rest.partition("{")
        whole = "::".join(x for x in (prefix, head.strip().strip(":") if brace else rest) if x)
        if brace:
            depth = 1
            end = next((i for i, c in enumerate(tail) if (depth := depth + (c == "{") - (c == "}")) == 0), len(tail))
            todo += [(whole, p) for p in reversed(_parts(tail[:end]))]
            continue
        parts = [p.strip() for p in whole.split(" as ")[0].split("::") if p.strip()]
        if parts and parts[-1] == "self" and prefix:
            parts.pop()
        elif len(parts) > 1 and (parts[-1] == "*" or parts[-1][0].isupper()):
            parts.pop()
        if parts:
            out.append("::".join(parts))
    return out


def import_modules(path: Column) -> Column:
    @F.pandas_udf("array<string>")
    def expand(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: brace_paths(p) if p else [])

    return expand(path)


def masked_scripts(text: str, front: bool = False) -> str:
    """A component file with all but its scripts (and leading front matter, if asked for) blanked: lines and columns stay."""
    keep = [m.span(1) for m in _SCRIPT.finditer(text)]
    if front and (m := _FRONT.match(text)):
        keep = [m.span(1), *[s for s in keep if s[0] >= m.end()]]
    out, at = [], 0
    for a, b in keep:
        out += [re.sub(r"[^\r\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\r\n]", " ", text[at:])])


def script_only(text: Column, front: bool = False) -> Column:
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked_scripts(t, front))

    return mask(text)
