"""A corpus pipeline of operators in graphloom.llm: classify, join near-duplicates, remove repeated passages, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Between stages, docs are read where the last stage left them.

Defined results: an empty text passes every stage (the classifier judges it by
its bias) and is packed as its end id; rows repeated under one id count as
copies, one of them stays; a document without an id always stays; a character that
the removal of passages cuts in part is left out; an empty table
gives an empty result; columns besides those of documents are carried along.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, jaccard_join, mixing, packing, quality_classifier, suffix_dedup
from graphloom.llm.common import read, written

#: Tables of ids that go are broadcast up to so many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 2_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.fitted_on(spark, read(spark, sf_dir, "documents"), sf_dir)
    return docs.where(model.score(F.col("text")) >= quality_classifier.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    found = jaccard_join.near_duplicates(docs)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    kept = docs.join(_small(gone), "doc_id", "left_anti")
    again = written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    few = _small(again)
    return kept.join(few, "doc_id", "left_anti").unionByName(kept.join(few, "doc_id").dropDuplicates(["doc_id"])).select(*docs.columns)


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str], list]:
    """docs with columns besides those of documents under names that clash with nothing, these names, and how to get all back."""
    own = ("doc_id", "text", "lang", "source", "n_chars")
    names = {c: c if c in own else f"_extra_{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(c).alias(n) for c, n in names.items()]), list(names.values()), [F.col(n).alias(c) for c, n in names.items()]


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document with a smaller id as well."""
    plain, names, back = _aside(docs)
    carry = tuple(c for c in names if c not in ("doc_id", "text", "n_chars"))
    left = suffix_dedup.dedup(plain, texts=True, carry=carry)
    return left.select("doc_id", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"), *carry).select(back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    plain, names, back = _aside(docs)
    return mixing.emit(mixing.mix(plain)).select(names).select(back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their token ids."""
    return packing.pack(docs)


class _Before(threading.local):
    def __init__(self) -> None:
        self.paths: list[str] = []


#: Intermediate tables of the stage before in this thread: they go when the next stage begins, as its docs are written by then.
_before = _Before()


def _in_turn(stage, first: bool = False):
    """The stage, with the tables that the stage before it made along its way deleted first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            common.drop_folders(spark, _before.paths)
        since = len(common.made.paths)
        out = stage(spark, docs, sf_dir)
        _before.paths = common.made.paths[since:]
        return out

    return run_stage


STAGES = [
    ("quality_classifier", _in_turn(quality, True)),
    ("jaccard_join", _in_turn(near_duplicates)),
    ("suffix_dedup", _in_turn(repeated_passages)),
    ("mixing", _in_turn(mixed)),
    ("packing", _in_turn(packed)),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
