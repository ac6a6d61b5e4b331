"""Column functions on names, paths, lines and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Lower-cased words of a name: runs of letters and digits, cut at camel humps; a run that was cut is kept whole as well."""
    runs = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda r: r != "")

    def parts(run: Column) -> Column:
        humps = F.regexp_replace(F.regexp_replace(run, r"(\P{Lu})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
        words = F.split(humps, " ")
        return F.when(F.size(words) > 1, F.concat(words, F.array(run))).otherwise(words)

    return F.transform(F.flatten(F.transform(runs, parts)), lambda w: F.lower(w))


#: Endings that a module name loses (fixed values).
MODULE_ENDINGS = (".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".rs")


def module_stem(module: Column) -> Column:
    """The name by which an import and a file meet: the last path segment without its ending, then its last dotted part, in small letters.

    A dotted segment stays whole if it begins with a dot or stands in a path.
    """
    whole = F.trim(module)
    segments = F.filter(F.split(whole, r"[/\\:]"), lambda s: F.trim(s) != "")
    last = F.coalesce(F.get(segments, F.size(segments) - 1), whole)
    bare = F.regexp_replace(last, "(?:" + "|".join(e.replace(".", r"\.") for e in MODULE_ENDINGS) + ")$", "")
    dotted = F.filter(F.split(bare, r"\."), lambda s: F.trim(s) != "")
    keep = bare.contains(".") & (bare.startswith(".") | (last != whole))
    return F.lower(F.trim(F.when(keep, bare).otherwise(F.coalesce(F.get(dotted, F.size(dotted) - 1), bare))))


def like_of_wildcard(pattern: str) -> str:
    """A LIKE pattern (escape \\) for * and ?; without either, the pattern may stand anywhere."""
    like = "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in pattern.lower())
    return like if "*" in pattern or "?" in pattern else f"%{like}%"


def like_of_glob(pattern: str) -> str:
    """A LIKE pattern (escape \\) that matches a whole value, with * and ?."""
    return "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in pattern.lower())


def like_of_substring(part: str, escape: bool = True) -> str:
    """A LIKE pattern for a part of a value; without escape, % and _ of the part are wildcards."""
    return "%" + ("".join("\\" + c if c in "%_\\" else c for c in part.lower()) if escape else part.lower()) + "%"


def url_segments(url: Column) -> Column:
    """Segments of a URL's path, without scheme, host and query."""
    path = F.when(url.contains("://"), F.regexp_replace(F.substring_index(F.substring(url, F.lit(1), F.length(url)), "://", -1), r"^[^/]*/?", "")).otherwise(url)
    return F.split(F.regexp_replace(F.substring_index(path, "?", 1), "^/+|/+$", ""), "/")


def route_segments(route: Column) -> Column:
    return F.split(F.regexp_replace(route, "^/+|/+$", ""), "/")


def is_parameter(segment: Column) -> Column:
    """Whether a route's segment is a parameter such as :id, {id}, <id> or *."""
    return segment.rlike(r"^(?::.*|\{.*\}|<.*>|\*.*)$")


def segments_match(route: Column, url: Column) -> Column:
    """Whether a route's segments are those of a URL: equal but for case, or parameters such as :id, {id}, <id> and *."""
    fits = F.zip_with(route, url, lambda r, u: is_parameter(r) | (F.lower(r) == F.lower(u)))
    return (F.size(route) == F.size(url)) & F.forall(fits, lambda x: x)


def path_words(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda w: w != ""))


def normalized_line(line: Column) -> Column:
    """A line with single spaces; null for blank lines, comments and imports."""
    one = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(~one.rlike(r"^(?:$|//|#|/\*|\*|import |use |package )"), one)


#: Words that say nothing of a domain (fixed values).
GENERIC_WORDS = ("build", "create", "delete", "export", "handle", "import", "process", "update")


def domain_tokens(name: Column) -> Column:
    """Words of four letters or more of a name that aren't generic verbs."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))


def normalized_evidence(rule_id: Column, evidence: Column) -> Column:
    """Evidence that survives moved lines: duplication rules lose their trailing line number."""
    return F.when(rule_id.startswith("DRY-"), F.regexp_replace(evidence, ":[0-9]*$", "")).otherwise(evidence)


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, then an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def slug(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "-"))


def terminal_name(name: Column) -> Column:
    """The last segment of a dotted, scoped or arrowed name, without generics and arguments."""
    return F.regexp_extract(F.regexp_replace(name, r"[<(\[].*$", ""), r"([^.:>\s]+)\s*$", 1)


def signature(source: Column, most: int = 200) -> Column:
    """The first line that is no attribute, decorator or comment, cut to so many characters."""
    lines = F.filter(F.transform(F.split(source, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(?:@|#|//|/\*|\*)"))
    return truncated(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), most)
