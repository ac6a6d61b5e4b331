"""Operator 6, document fingerprints: SimHash of 128 bits.

The terms of a text are its pairs of neighbouring words (its one word, if it has
one), lower-cased. Each occurrence of a term votes, so a term weighs its
frequency: bit i of a term's hash votes for or against bit i of the fingerprint.
Votes are sums over exploded terms, several counts to a long. Texts are not
shuffled for this: the sums are made where the text is read and only they move.

``search`` finds all fingerprints within a Hamming radius of a set of queries:
the bits are cut into blocks, and there is a table for each choice of blocks
that must agree when no more bits differ than the radius. ``counted`` does the
same and counts the rows found for each query.

Defined results: a null or empty text has the fingerprint of no votes, all
zeros; equal texts have equal fingerprints, so repeated rows do as well; a tied
vote gives a 0 bit; a null key is a key like others; an empty table gives an
empty result; columns other than the key and the text are not used, whatever
their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import let, partitions_for, read, words_of, written

BITS = 128
#: So many votes fit in a byte, and in the top byte of a signed long.
_CHUNK = 127
_BYTES = 0x0101010101010101
_BYTE_PAIR = 0x000000FF000000FF
_LOW = 0xFFFFFFFF


def term_hashes(text: Column) -> Column:
    """A hash for each term of a text, one more time for each time it occurs."""

    def pairs(words: Column) -> Column:
        one = F.transform(words, lambda w: F.xxhash64(w))
        two = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
        return F.when(F.size(words) < 2, one).otherwise(two)

    return let(words_of(F.lower(F.coalesce(text, F.lit("")))), pairs)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys with f0 and f1, the two halves of the fingerprint. Rows with equal keys must have equal texts.

    First, votes of up to 127 terms are summed in bytes, eight to a long; then these sums in 32-bit counts, two to a long.
    """
    terms = rows.select(*keys, F.posexplode_outer(term_hashes(F.col(text))).alias("pos", "h0"))
    terms = terms.select(*keys, F.floor(F.coalesce(F.col("pos"), F.lit(0)) / _CHUNK).cast("int").alias("chunk"), "h0", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")).alias("h1"))
    bytes_of = lambda h, i: F.sum(F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit(_BYTES)))
    small = terms.groupBy(*keys, "chunk").agg(F.count("h0").alias("n"), *[bytes_of(h, i).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(8)])
    pair_of = lambda h, i, j: F.sum(F.shiftrightunsigned(F.col(f"{h}_{i}"), 8 * j).bitwiseAND(F.lit(_BYTE_PAIR)))
    votes = small.groupBy(*keys).agg(F.sum("n").alias("n"), *[pair_of(h, i, j).alias(f"{h}_{i}_{j}") for h in ("h0", "h1") for i in range(8) for j in range(4)])

    def half(h: str) -> Column:
        bits = F.lit(0).cast("long")
        for i in range(8):
            for byte in range(8):
                count = F.shiftrightunsigned(F.col(f"{h}_{i}_{byte % 4}"), 32 * (byte // 4)).bitwiseAND(F.lit(_LOW))
                bits = bits.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i + 8 * byte)).otherwise(F.lit(0).cast("long")))
        return bits

    return votes.select(*keys, half("h0").alias("f0"), half("h1").alias("f1"))


def as_hex(f0: Column, f1: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(f), 16, "0")) for f in (f0, f1)])


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def _bits(f0: Column, f1: Column, start: int, end: int) -> list[Column]:
    """The bits from start to end of the 128, as one number for each half that they lie in."""
    parts = []
    for half, base in ((f0, 0), (f1, 64)):
        low, high = max(start, base) - base, min(end, base + 64) - base
        if low < high:
            part = F.shiftrightunsigned(half, low)
            parts.append(part if high - low == 64 else part.bitwiseAND(F.lit((1 << (high - low)) - 1)))
    return parts


def block_keys(f0: Column, f1: Column, radius: int, blocks: int) -> Column:
    """An array of one key for each table: two fingerprints within the radius share one at least.

    At most radius blocks hold a differing bit, so blocks - radius agree; each choice of so many is a table.
    """
    if not radius < blocks <= BITS:
        raise ValueError("blocks must be more than the radius and at most 128")
    part = [_bits(f0, f1, BITS * i // blocks, BITS * (i + 1) // blocks) for i in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(t), *[bits for i in chosen for bits in part[i]]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def _near(queries: DataFrame, index: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(q0, q1, f0, f1, distance): each fingerprint of index within the radius of one of queries, once.

    Spark sizes a side as if it had not been exploded into its tables, so it could broadcast the whole index: both sides are shuffled, whatever it thinks.
    """
    once = index.select("f0", "f1").distinct()
    asked = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    left = asked.withColumn("b", F.explode(block_keys(F.col("q0"), F.col("q1"), radius, blocks)))
    right = once.withColumn("b", F.explode(block_keys(F.col("f0"), F.col("f1"), radius, blocks)))
    apart = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    return left.hint("shuffle_merge").join(right.hint("shuffle_merge"), "b").where(apart <= radius).select("q0", "q1", "f0", "f1", apart.alias("distance")).distinct()


def search(queries: DataFrame, index: DataFrame, key: str = "doc_id", radius: int = 6, blocks: int = 8) -> DataFrame:
    """(query, found, distance) for each row of index within the radius of a row of queries; both have key, f0 and f1.

    The index is first brought to one row for each fingerprint, so copies meet a query once and are joined on at the end.
    """
    named = queries.select(F.col(key).alias("query"), F.col("f0").alias("q0"), F.col("f1").alias("q1"))
    found = index.select(F.col(key).alias("found"), "f0", "f1")
    return _near(queries, index, radius, blocks).join(named, ["q0", "q1"]).join(found, ["f0", "f1"]).select("query", "found", "distance")


def counted(queries: DataFrame, index: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(f0, f1, n): for each fingerprint of queries, how many rows of index are within the radius; copies are counted, not listed."""
    rows = index.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("rows"))
    near = _near(queries, index, radius, blocks).join(rows, ["f0", "f1"])
    return near.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("rows").alias("n"))


def _range_of(key: Column, cuts: list) -> Column:
    """How many of the sorted cuts are below a key, by about two comparisons for each root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    some = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    number = lambda values: F.array(*[F.lit(c) for c in values])
    coarse = F.size(F.filter(number([c[-1] for c in some[:-1]]), lambda c: c < key)) if len(some) > 1 else F.lit(0)
    fine = F.array(*[number(c) for c in some])
    return let(coarse, lambda c: c * step + F.size(F.filter(F.get(fine, c), lambda x: x < key)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, row, key, text, next_range, next_row, next_text): the document that follows in descending order of the key; after the last, the first.

    range and row name one row each, whatever keys are null or repeated: rows are numbered within their range from 1.

    The keys are cut into ranges of like size; a range's last row takes the head of the next range that has rows.
    Rows stay partitioned and sorted by range: the join with the heads and grouping by range and more shuffle no text again.
    """
    spark = docs.sparkSession
    n = partitions_for(spark, 2)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = sorted(set(rows.where("key is not null").select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)))
    rows = rows.withColumn("range", F.when(F.col("key").isNull(), F.lit(-1)).otherwise(_range_of(F.col("key"), cuts)))
    order = [F.col("key").desc_nulls_last(), F.col("text").desc()]
    here = Window.partitionBy("range").orderBy(*order)
    led = rows.withColumns({"row": F.row_number().over(here).cast("long"), "next": F.lead(F.struct("range", "text")).over(here)})
    # heads: (range, text) of the first row of each range, kept by the range before it; ranges are as many as partitions are
    firsts = rows.groupBy("range").agg(F.max_by(F.struct("range", "text"), F.struct("key", "text")).alias("head"))
    ranges = sorted((r.range for r in rows.select("range").distinct().collect()), reverse=True)
    follows = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "before int, range int")
    heads = firsts.join(F.broadcast(follows), "range").select(F.col("before").alias("range"), "head")
    full = led.join(heads, "range").withColumn("next_row", F.when(F.col("next").isNull(), F.lit(1)).otherwise(F.col("row") + 1).cast("long"))
    full = full.withColumn("next", F.coalesce(F.col("next"), F.col("head")))
    return full.select("range", "row", F.col("key").alias(key), "text", F.col("next.range").alias("next_range"), "next_row", F.col("next.text").alias("next_text"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of all documents; n_near counts the other rows within 6 bits of those whose id is divisible by 100."""
    m = F.floor(F.length("text") / 3).cast("int")
    docs = with_next(read(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - m), F.substring(F.col("next_text"), F.lit(1), m)))
    own = ["range", "row", "doc_id", "next_range", "next_row", "n_chars"]
    both = docs.select(*own, F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))))
    both = both.withColumn("sha", F.when(F.col("which") == 1, F.unhex(F.sha2(F.encode("t", "UTF-8"), 256))))
    made = fingerprints(both, [*own, "which", "sha"], "t")  # the window has dealt the rows by range
    pairs = made.groupBy(*own).agg(*[F.max(F.when(F.col("which") == w, F.struct("f0", "f1", "sha"))).alias(name) for w, name in ((0, "a"), (1, "e"))])
    pairs = pairs.select(*own, "a.f0", "a.f1", F.col("e.f0").alias("e0"), F.col("e.f1").alias("e1"), F.col("e.sha").alias("sha"))
    pairs = written(pairs, "fingerprints")  # votes are summed once; what follows reads narrow rows
    after = pairs.select(F.col("range").alias("next_range"), F.col("row").alias("next_row"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    asks = F.col("doc_id") % 100 == 0
    near = counted(pairs.where(asks), pairs)
    like = lambda *x: 1 - distance(*x) / F.lit(float(BITS))
    f0, f1, e0, e1 = (F.col(x) for x in ("f0", "f1", "e0", "e1"))
    return pairs.join(after, ["next_range", "next_row"]).join(near, ["f0", "f1"], "left").select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_hex(f0, f1).alias("fingerprint"), as_hex(e0, e1).alias("edited_fingerprint"),
        like(f0, f1, e0, e1).alias("near_edited"), like(f0, f1, F.col("n0"), F.col("n1")).alias("near_next"), F.when(asks, F.col("n") - 1).alias("n_near"),
    )
