"""Operator 8, quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are word n-grams of one and two words, once of the words as they stand
and once of their shapes (runs of letters, capitals and digits shrunk to one
sign each, other characters kept; a pair also says whether its words are equal).
A family's weights are averaged over its n-grams, so a score is a sparse dot
product, and long texts score like short ones.

Training takes at most ``sample`` labelled rows, those with the smallest hashes
of their ids, and runs in one task over that bounded sample; the model is one
array of 2 ** bits weights. Scoring covers all rows, without a shuffle.

Defined results: a null or empty text has no n-gram and scores as the bias
alone; a null label or a label without a document is not learnt from; repeated
rows count each; without labelled rows, or with one class alone, the score is
the share of that class (0.5 without rows); a null doc_id is never held out and
is not learnt from; ties do not arise; other columns are kept, but for one
named like the score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext
from graphloom.llm.common import read

#: A class of characters for each byte: letters (bytes of other alphabets too), capitals, digits, the rest as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:256] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
FAMILIES = 4


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: the feature of each n-gram, and the first n-gram of each text and the end."""
    starts, ends, first = bytetext.words(data, offsets)
    surface = bytetext.words_hash(data, starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = bytetext.words_hash(shape[keep], at[starts], at[ends])
    same = np.zeros(len(surface), np.uint64)
    same[:-1] = surface[:-1] == surface[1:]
    inside = np.ones(max(0, len(surface) - 1), bool)
    edges = first[1:-1]
    inside[edges[(edges > 0) & (edges < len(surface))] - 1] = False
    pairs = np.concatenate([[0], np.cumsum(inside)])[np.clip(first, 0, len(inside))]
    out = []
    for family, (h, bounds) in enumerate(
        ((surface, first), (bytetext.combined(surface, 2)[inside], pairs), (shapes, first), (bytetext.mixed(bytetext.combined(shapes, 2) + same[: max(0, len(same) - 1)])[inside], pairs))
    ):
        salted = bytetext.mixed(h + np.uint64(family * 0x51ED27))
        out.append(((salted >> np.uint64(64 - bits)).astype(np.int64), bounds))
    return out


def means(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """The sum over families of the mean weight of each text's n-grams."""
    total = np.zeros(len(offsets) - 1)
    for index, bounds in features(data, offsets, bits):
        sums = np.concatenate([[0.0], np.cumsum(weights[index])])
        n = np.diff(bounds)
        total += np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), 0.0)
    return total


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal, with a rate for each coordinate."""

    bits: int
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.01

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def trained(texts: pa.Array, labels: np.ndarray, bits: int, passes: int) -> tuple[np.ndarray, float]:
    """(weights, bias) from rows in the order given."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return np.zeros(1 << bits), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    rows = []
    for _, _, data, offsets in bytetext.pieces(*bytetext.of_arrow(texts)):
        families = features(data, offsets, bits)
        for t in range(len(offsets) - 1):
            parts = [index[bounds[t] : bounds[t + 1]] for index, bounds in families]
            index, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            value = np.bincount(inverse, np.concatenate([np.full(len(p), 1 / max(1, len(p))) for p in parts]), len(index))
            rows.append((np.append(index, 1 << bits), np.append(value, 1.0)))
    model = Ftrl(bits)
    for _ in range(passes):
        for (index, value), label in zip(rows, labels, strict=True):
            model.learn(index, value, float(label))
    w = model.weights(slice(None))
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: Column) -> Column:
        """The probability of label 1, as a column."""
        weights, bias, bits = self.weights, self.bias, self.bits

        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                parts = [means(weights, data, offsets, bits) for _, _, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch))]
                raw = np.concatenate(parts) if parts else np.zeros(0)
                yield pa.array(1 / (1 + np.exp(-np.clip(raw + bias, -35, 35))), pa.float64())

        scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(scored, "double")(text)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", bits: int = 18, passes: int = 3) -> Model:
    """A model of all rows of labelled, which must be a bounded sample: they meet in one task, in the order of their keys' hashes."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(F.col(key)).alias("o"), F.col(text).alias("text"), F.col(label).cast("double").alias("label"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else pa.table({"o": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.float64())})
        table = table.sort_by([("o", "ascending"), ("text", "ascending")])
        weights, bias = trained(table["text"], table["label"].to_numpy(), bits, passes)
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    made = rows.repartition(1).mapInArrow(train, "weights binary, bias double").first()
    if made is None:  # Spark runs no task over what it knows to be empty
        return Model(np.zeros(1 << bits), 0.0, bits)
    return Model(np.frombuffer(made["weights"], np.float32).astype(np.float64), made["bias"], bits)


def sampled(labels: DataFrame, docs: DataFrame, label: str, sample: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most sample rows (key, text, label) of documents with a label; the sample of labels is what is broadcast."""
    few = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias(key), F.col(label).alias("label"))
    few = few.orderBy(F.xxhash64(key), "label").limit(sample)
    return docs.select(key, text).join(F.broadcast(few), key)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted_on(spark: SparkSession, docs: DataFrame, sf_dir: str, sample: int = 12_000) -> Model:
    """The classifier of labels.quality, from labels that aren't held out, of rows in docs."""
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return fit(sampled(labels, docs, "quality", sample))


#: From this score on, a text is predicted to have label 1.
THRESHOLD = 0.7


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fitted_on(spark, docs, sf_dir)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
