"""Trees of paths: which files ignore rules leave out, and digests of folders from those of what they hold.

Both go over folders as rows: a path is joined with the rules of its folders, and a
folder's digest is an aggregate over the level below. Nothing walks a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import files as fx
from graphloom.operators.trace import _cut


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _prefixes(path: Column) -> Column:
    """The path itself and all folders above it, but the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignore_patterns(rules: DataFrame) -> DataFrame:
    """(folder, n, negated, folders_only, regex) of lines of ignore files (folder, n, line); the root is the folder ''.

    Empty lines and comments say nothing. A pattern with a slash before its end is of its folder alone, others of any depth below;
    one that ends with a slash is of folders; ** stands for any folders, * and ? for what is within a name, ! takes a path in again.
    """
    # spaces at the end are no part of a pattern unless the last one is escaped
    line = F.regexp_replace(F.col("line"), r"(?<!\\) +$", "")
    held = rules.withColumn("_p", line).where((F.col("_p") != "") & ~F.col("_p").startswith("#"))
    negated = F.col("_p").startswith("!")
    held = held.withColumn("negated", negated).withColumn("_p", F.when(negated, F.substring("_p", 2, 1 << 20)).otherwise(F.col("_p")))
    held = held.withColumn("folders_only", F.col("_p").endswith("/")).withColumn("_p", F.regexp_replace("_p", "/+$", "")).where("_p <> ''")
    anchored = F.col("_p").contains("/")
    plain = F.regexp_replace(F.regexp_replace("_p", "^/", ""), r"\\(.)", "\u0001$1")  # an escaped character is itself
    quoted = F.regexp_replace(plain, r"([.+^$(){}|])", r"\\$1")
    for what, by in (("^\\*\\*/", "\u0002"), ("/\\*\\*/", "/\u0002"), ("/\\*\\*$", "/\u0003"), ("(?<!\u0001)\\*+", "[^/]*"), ("(?<!\u0001)\\?", "[^/]"), ("\\[!", "[^"), ("\u0002", "(?:.*/)?"), ("\u0003", ".+"), ("\u0001(.)", "\\\\$1")):
        quoted = F.regexp_replace(quoted, what, by)
    regex = F.concat(F.lit("^"), F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?")), quoted, F.lit("$"))
    return held.select("folder", "n", "negated", "folders_only", regex.alias("regex"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of files (path) by the lines of ignore files (folder, n, line).

    Of the rules that match a path, the last line of the deepest folder counts. A file in a folder that is left out is left out, whatever
    is said of the file. Paths that stand several times are one; a null path is left out of the result.
    """
    files = paths.select("path").where("path IS NOT NULL").distinct()
    held = _cut(files.select("path", F.posexplode(_prefixes(F.col("path"))).alias("_at", "entry"), F.size(F.split("path", "/")).alias("_depth")))
    entries = held.groupBy("entry").agg((F.min(F.col("_at") + 1 - F.col("_depth")) < 0).alias("is_folder"))
    # each entry with the rules of the folders above it
    above = entries.withColumn("folder", F.explode(F.concat(F.array(F.lit("")), F.slice(_prefixes(F.col("entry")), F.lit(1), F.size(F.split("entry", "/")) - 1))))
    met = above.join(ignore_patterns(rules), "folder").where("is_folder OR NOT folders_only")
    rest = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    met = met.where(F.regexp_like(rest, F.col("regex")))
    last = met.groupBy("entry").agg(F.max_by("negated", F.struct(F.length("folder"), "n")).alias("negated")).where("NOT negated").select("entry", F.lit(True).alias("_out"))
    return held.join(last, "entry", "left").groupBy("path").agg(F.coalesce(F.bool_or("_out"), F.lit(False)).alias("ignored"))


def digests(files: DataFrame) -> DataFrame:
    """(path, digest, is_folder) of files (path, content_hash) and of all folders above them; the root is ''.

    A folder's digest is of the names, kinds and digests of what it holds, in order of the names, so equal folders have equal digests
    wherever they stand, and a change moves those above it alone. A level is an aggregate over the one below. The first content of a
    repeated path counts.
    """
    level = files.where("path IS NOT NULL").groupBy("path").agg(F.min("content_hash").alias("digest")).withColumn("is_folder", F.lit(False))
    level = _cut(level.withColumn("_depth", F.size(F.split("path", "/"))))
    done = [level.select("path", "digest", "is_folder")]
    deepest = level.agg(F.max("_depth")).first()[0] or 0
    below = level
    for depth in range(deepest, 0, -1):
        here = below.where(F.col("_depth") == depth)
        line = F.concat_ws("\t", F.regexp_replace("path", "^.*/", ""), F.when(F.col("is_folder"), "d").otherwise("f"), F.coalesce("digest", F.lit("")))
        made = here.groupBy(_parent(F.col("path")).alias("path")).agg(F.md5(F.array_join(F.sort_array(F.collect_list(line)), "\n").cast("binary")).alias("digest"))
        made = _cut(made.select("path", "digest", F.lit(True).alias("is_folder"), F.lit(depth - 1).alias("_depth")))
        done.append(made.select("path", "digest", "is_folder"))
        below = below.where(F.col("_depth") < depth).unionByName(made)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def changed_subtrees(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, is_folder, change) of what differs between two tables of digests(): what is new, gone or changed, but nothing below a folder that is new or gone."""
    a, b = now.select("path", "is_folder", F.col("digest").alias("_now")), before.select("path", F.col("is_folder").alias("_folder"), F.col("digest").alias("_before"))
    held = a.join(b, "path", "full").where(~F.col("_now").eqNullSafe(F.col("_before")))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").otherwise("changed")
    held = _cut(held.select("path", F.coalesce("is_folder", "_folder").alias("is_folder"), change.alias("change")))
    top = held.where("is_folder AND change <> 'changed'").select(F.col("path").alias("_parent"), F.col("change").alias("_change"))
    return held.withColumn("_parent", F.when(F.col("path") != "", _parent(F.col("path")))).join(top, "_parent", "left").where(~F.col("_change").eqNullSafe(F.col("change"))).select("path", "is_folder", "change")


def worktree_fingerprint(status: DataFrame, files: DataFrame) -> DataFrame:
    """One row (fingerprint): a digest of what is changed (status: path, state) and its content (files: path, content_hash); null if nothing is."""
    held = status.join(files.select("path", "content_hash"), "path", "left")
    line = F.concat_ws("\t", "path", "state", F.coalesce("content_hash", F.lit("-")))
    return _folded(held, line, ["path", "state"])


def dependency_fingerprint(files: DataFrame, command: str) -> DataFrame:
    """One row (fingerprint): a digest of a command and the manifests and locks (path, content_hash) that it depends on."""
    held = files.where(fx.is_manifest(F.col("path"))).select("path", F.concat_ws("\t", "path", F.coalesce("content_hash", F.lit("-"))).alias("line"))
    made = _folded(held, F.col("line"), ["path"])
    return made.select(F.md5(F.concat_ws("\n", F.lit(command), "fingerprint").cast("binary")).alias("fingerprint"))


def task_fingerprints(tasks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """tasks with fingerprint: a digest of these columns in order, nulls told from empty texts."""
    one = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return tasks.withColumn("fingerprint", F.md5(F.concat_ws("\x1f", *one).cast("binary")))


def _folded(rows: DataFrame, line: Column, order: list[str], buckets: int = 1024) -> DataFrame:
    """A digest of lines in order, by buckets whose digests are folded: no task holds all lines. Null for none."""
    part = rows.select(F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("_b"), line.alias("_l")).groupBy("_b").agg(F.md5(F.array_join(F.sort_array(F.collect_list("_l")), "\n").cast("binary")).alias("_d"))
    return part.agg(F.when(F.count(F.lit(1)) > 0, F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_d"))), lambda x: F.concat_ws(":", x["_b"].cast("string"), x["_d"])), ",").cast("binary"))).alias("fingerprint"))
