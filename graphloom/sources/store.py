"""The graph on disk: plain Parquet tables, partitioned by buckets of files, refreshed by what has changed.

Every row of a table has the file that it belongs to, so a refresh overwrites the
buckets of changed files alone (Spark's dynamic partition overwrite); the files of
other buckets stay as they are. Edges of calls are kept as a table too, by buckets of
the called name: a change of files changes the edges of the names that these files
define or call, before or after, and only those are joined anew.

Rows of a bucket that is left empty are deleted with their folder. A folder is of one
schema version and one number of buckets; others are other folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema
from graphloom.operators import graph, index
from graphloom.operators.index import upserted
from graphloom.operators.trace import _cut

VERSION = 4
BUCKETS = 64


def _owned(kind: T.StructType) -> T.StructType:
    """A schema with the file that a row belongs to."""
    return kind if "file_id" in kind.names else T.StructType([T.StructField("file_id", T.LongType()), *kind.fields])


TABLES = {
    "files": schema.FILES, "symbols": schema.SYMBOLS, "calls": _owned(schema.CALLS), "extends": _owned(schema.EXTENDS), "imports": schema.IMPORTS, "exports": schema.EXPORTS,
    "service_links": _owned(schema.SERVICE_LINKS),
}
#: Of each call by name: who calls and what is meant.
EDGES = T.StructType([T.StructField("name", T.StringType()), T.StructField("caller_id", T.LongType()), T.StructField("id", T.LongType())])
LISTING = ("path", "mtime", "size", "content_hash")


def file_id(path: Column) -> Column:
    return F.xxhash64(path)


class Index:
    """The tables of one source tree below a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, f"{root.rstrip('/')}/v{VERSION}-{buckets}", buckets

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> DataFrame:
        """A table, empty if nothing was ever written."""
        kind = EDGES if name == "edges" else TABLES[name]
        if not self._there(self._folder(name)):
            return self.spark.createDataFrame([], kind)
        with_bucket = T.StructType([*kind.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(with_bucket).parquet(self._folder(name)).drop("bucket")

    def _key(self, name: str) -> str:
        return {"edges": "name", "files": "id"}.get(name, "file_id")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _replace(self, name: str, keys: DataFrame, new: DataFrame | None) -> None:
        """Puts new in the place of the rows of keys (a column named as the table's key); other buckets are not touched."""
        kind, key = (EDGES if name == "edges" else TABLES[name]), self._key(name)
        touched = [r.bucket for r in keys.select(self._bucket(key).alias("bucket")).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]
        kept = None
        if self._there(self._folder(name)):
            with_bucket = T.StructType([*kind.fields, T.StructField("bucket", T.IntegerType())])
            held = self.spark.read.schema(with_bucket).parquet(self._folder(name)).where(F.col("bucket").isin(touched)).drop("bucket")
            kept = held.join(keys.select(key).distinct(), key, "left_anti").select(columns)
        made = new.select(columns) if new is not None else None
        out = kept if made is None else made if kept is None else kept.unionByName(made)
        if out is None:
            return
        out = _cut(out.withColumn("bucket", self._bucket(key)))
        left = {r.bucket for r in out.select("bucket").distinct().collect()}
        if left:
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self._folder(name))
        for bucket in sorted(set(touched) - left):
            self._delete(f"{self._folder(name)}/bucket={bucket}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def upsert(self, tables: dict[str, DataFrame], gone: DataFrame | None = None) -> None:
        """Replaces all that belongs to the files in tables['files'] and drops what belongs to gone (id), and joins the edges anew whose names have changed."""
        ids = tables["files"].select("id")
        ids = _cut((ids if gone is None else ids.unionByName(gone.select("id"))).distinct())
        owners = ids.select(F.col("id").alias("file_id"))
        of_files = lambda t: t.join(owners, "file_id", "left_semi")
        names_of = lambda symbols, calls: symbols.select("name").unionByName(calls.select(F.col("callee").alias("name")))
        before = _cut(names_of(of_files(self.table("symbols")), of_files(self.table("calls"))).distinct())
        for name in TABLES:
            self._replace(name, ids if name == "files" else owners, tables.get(name))
        after = names_of(of_files(self.table("symbols")), of_files(self.table("calls")))
        self._join_edges(_cut(before.unionByName(after).distinct()))

    def _join_edges(self, names: DataFrame) -> None:
        calls = self.table("calls").join(names.select(F.col("name").alias("callee")), "callee", "left_semi")
        symbols = self.table("symbols").join(names, "name", "left_semi")
        met = graph.callers(calls, symbols).join(symbols.select("id", "name"), "id").select("name", "caller_id", "id").distinct()
        self._replace("edges", names, met)

    def refresh(self, listing: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]], scope: DataFrame | None = None) -> DataFrame:
        """Brings the index up to a listing (path, mtime, size, content_hash and what parse needs), within a scope of paths if given. One row of counters.

        Files of the same time and size, or the same content, keep their rows; what is parsed anew is new, changed or renamed. parse gives
        the tables of the listing's rows that it is handed, with file_id as file_id() has it.
        """
        known = self.table("files")
        old = known.select(*LISTING)
        actions = _cut(index.classify(listing.select(*LISTING), old))
        gone = _cut(index.removed(listing, old, scope))
        changed = listing.join(actions.where("action IN ('parsed', 'renamed')").select("path"), "path", "left_semi")
        touched = actions.where("action = 'touched'").select("path")
        if touched.limit(1).count():
            times = listing.join(touched, "path", "left_semi").select(F.col("path").alias("_path"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
            moved = _cut(known.join(times, F.col("path") == F.col("_path")).withColumns({"mtime": F.col("_m"), "size": F.col("_s")}).drop("_path", "_m", "_s"))
            self._replace("files", moved.select("id"), moved)
        if changed.limit(1).count() or gone.limit(1).count():
            self.upsert({k: _cut(v) for k, v in parse(changed).items()}, gone.select(file_id(F.col("path")).alias("id")))
        return index.report(actions, gone)

    def export(self, to: str, level: int = 9) -> None:
        """The tables as one snapshot folder, compressed with zstd."""
        for name in TABLES:
            self.table(name).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(f"{to}/{name}")

    def seed(self, snapshot: str) -> bool:
        """Takes the tables of a snapshot if there are no files yet; a refresh then brings what has changed since."""
        if self.table("files").limit(1).count():
            return False
        self.upsert({name: self.spark.read.schema(kind).parquet(f"{snapshot}/{name}") for name, kind in TABLES.items()})
        return True


def parsed_files(listing: DataFrame) -> dict[str, DataFrame]:
    """The tables of Python sources (path, mtime, size, content_hash, text), for refresh()."""
    from graphloom.functions import files as fx
    from graphloom.operators import extraction, findings
    from graphloom.sources import python_ast

    held = listing.withColumn("file_id", file_id(F.col("path")))
    made = extraction.tables(_cut(python_ast.nodes(held)))
    symbols = _cut(made["symbols"])
    owner = symbols.select(F.col("id").alias("symbol_id"), "file_id")
    owned = {name: made[name].join(owner, "symbol_id") for name in ("calls", "extends", "service_links")}
    files = held.select(F.col("file_id").alias("id"), "path", fx.language(F.col("path")).alias("language"), "content_hash", "mtime", "size", fx.is_test(F.col("path")).alias("is_test"), F.col("mtime").alias("last_indexed"))
    files = files.join(findings.fingerprints(symbols).withColumnRenamed("file_id", "id"), "id", "left")
    return {"files": files, "symbols": symbols, "imports": made["imports"], "exports": made["exports"], **owned}


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key: a registry of which every entry is an update."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("r")).select(key, "r.*")


def replaced(table: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return upserted(table, new, key)
