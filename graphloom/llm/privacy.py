"""Operator 12, personal data: information-theoretic sanitisation.

Protected entities are the values that fixed patterns find: e-mail addresses, IP
addresses, card and phone numbers. What a term t tells about an entity e is their
pointwise mutual information over the corpus, and what there is to tell is the
entity's information content, with N different texts, df(x) of them that hold x
and df(e, t) in which t stands within WINDOW terms of e:

    PMI(e; t) = ln(df(e, t) * N / (df(e) * df(t)))      IC(e) = ln(N / df(e))

A term discloses an entity if it stands near it in SUPPORT different texts or more
and PMI >= GENERALISE * IC. It is then generalised wherever it stands, in any
document, and removed where PMI >= REMOVE * IC. Equal texts count once, so that
copies don't make their words look telling.

1. Entities and the terms beside them are read from the texts, as hashes.
2. Pairs with support are candidates; a further pass counts the texts that hold
   their terms. Candidates are sent to the tasks as a bitmap of fixed size; what
   it lets through is counted by term where the text is read, but for texts that
   stand more than once (a bitmap too), whose terms are counted by text.
3. A last pass finds the entities and telling terms of each document. The telling
   terms are sent to the tasks if they are few (counted), otherwise the texts that
   hold some are joined with them by the texts' hashes.

Defined results: a null or empty text has no spans; equal texts have equal
results; repeated rows give a row each; a null key is carried along; an empty
table gives an empty result; columns other than key and text are not read,
whatever their names. Spans of one start are in order of their kinds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext
from graphloom.llm.common import bitmap, bits_set, read, written
from graphloom.llm.lexical_search import TERM

KINDS = ("email", "ip", "card", "phone")
#: Terms before and after an entity that count as near it.
WINDOW = 8
#: Texts in which a term must stand near an entity.
SUPPORT = 2
#: Shares of an entity's information content from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.95, 1.0
#: Bits of the bitmap of candidates, and telling terms that are sent to the tasks at most.
BITS, SENT = 24, 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SEARCHED = re.compile(r"[@0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, leftmost first: each @ is looked at once, so that no text takes long."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind, end, value) of all base matches, by start and kind; value leaves out how a number is set."""
    if not _SEARCHED.search(text):
        return []
    found = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.groups()):
                found.append((m.start(), 1, m.end(), m.group()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = re.sub(r"[^0-9]", "", m.group())
                if 9 <= len(digits) <= 15:
                    found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _terms(raw: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first of each text, hash) of terms: runs of letters, digits and all beyond ASCII, A-Z in lower case."""
    starts, ends, first = bytetext.terms(raw, offsets, TERM)
    return starts, ends, first, bytetext.words_hash(bytetext.LOWER[raw], starts, ends)


def _places(raw: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def met(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(doc, entity, term): which terms stand near which entities in each text, as hashes; a term of 0 stands for the entity itself."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for t in batch.column(0):
                value = t.as_py() or ""
                spans = entities(value)
                if not spans:
                    continue
                raw = np.frombuffer(value.encode(), np.uint8)
                doc = _hashed(raw.tobytes())
                starts, ends, _, h = _terms(raw, np.array([0, len(raw)]))
                place = _places(raw)
                begin, end = place[starts], place[ends]
                inside = np.zeros(len(begin), bool)
                for a, _, b, _ in spans:
                    inside[np.searchsorted(end, a, "right") : np.searchsorted(begin, b)] = True
                pairs = set()
                for a, kind, b, own in spans:
                    entity = _hashed(KINDS[kind].encode(), own.encode())
                    left, right = np.searchsorted(end, a, "right"), np.searchsorted(begin, b)
                    near = np.concatenate([np.arange(max(0, left - window), left), np.arange(right, min(len(begin), right + window))])
                    pairs.add((doc, entity, 0))
                    pairs.update((doc, entity, x) for x in h[near[~inside[near]]].view(np.int64).tolist())
                rows += pairs
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc", "entity", "term"])

    return docs.select(text).mapInArrow(find, "doc long, entity long, term long")


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([_hashed(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def texts_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc, n): the hash of each different text, and how often it is there."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(*bytetext.of_arrow(batch.column(0))))], ["doc"])

    return docs.select(text).mapInArrow(hashed, "doc long").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def holding(docs: DataFrame, text: str, marks, bits: int, copied=None) -> DataFrame:
    """(doc, term, n): the terms that marks, a bitmap in a broadcast, lets through, of each text.

    With copied, a bitmap of texts, only these have rows of their own; all others are counted by term, without their hashes.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(0)), 8_000_000):
                doc = _hashes(data, offsets)
                _, _, first, h = _terms(data, offsets)
                own = np.ones(len(doc), bool) if copied is None else bits_set(copied.value, doc.view(np.uint64), bits)
                here = np.flatnonzero(bits_set(marks.value, h, bits))
                names, which = np.unique(h[here], return_inverse=True)
                of = np.repeat(np.arange(len(doc)), np.diff(first))[here]
                pair = np.unique((of << 32) | which)
                of, which = pair >> 32, pair & 0xFFFFFFFF
                alone = own[of]
                n = np.bincount(which[~alone], minlength=len(names))
                some = np.flatnonzero(n)
                terms = np.concatenate([names[which[alone]], names[some]]).view(np.int64)
                docs_ = pa.concat_arrays([pa.array(doc[of[alone]]), pa.nulls(len(some), pa.int64())])
                yield pa.RecordBatch.from_arrays([docs_, pa.array(terms), pa.array(np.concatenate([np.ones(int(alone.sum()), np.int64), n[some]]))], ["doc", "term", "n"])

    return docs.select(text).mapInArrow(find, "doc long, term long, n long")


def disclosing(docs: DataFrame, text: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, remove) of the terms that disclose an entity."""
    spark = docs.sparkSession
    seen = written(met(docs, text, window).distinct(), "privacy-met")
    of_entity = seen.where("term = 0").groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    joint = written(seen.where("term <> 0").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support), "privacy-joint")
    marks = spark.sparkContext.broadcast(bitmap(joint, "term", BITS))
    texts = written(texts_of(docs, text), "privacy-texts")
    n = texts.count()
    copied = spark.sparkContext.broadcast(bitmap(texts.where("n > 1"), "doc", BITS))
    held = written(holding(docs, text, marks, BITS, copied), "privacy-held")
    alone = held.where("doc IS NOT NULL").select("doc", "term").distinct().select("term", F.lit(1).cast("long").alias("n"))
    of_term = held.where("doc IS NULL").select("term", "n").unionByName(alone).groupBy("term").agg(F.sum("n").alias("df_t"))
    pmi = F.log(F.col("both") * F.lit(float(max(n, 1))) / (F.col("df_e") * F.col("df_t")))
    ic = F.log(F.lit(float(max(n, 1))) / F.col("df_e"))
    judged = joint.join(of_entity, "entity").join(of_term, "term").withColumn("share", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    eps = 1e-9
    found = judged.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise - eps).select("term", (F.col("share") >= remove - eps).alias("remove"))
    return written(found, "privacy-terms")


def _general(word: str) -> str:
    """What stands for a term that is generalised: its kind."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def _row(value: str, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, which: np.ndarray, gone: np.ndarray):
    """Counts, spans and the sanitised text of one text; which of its terms disclose, and which of these are removed."""
    spans = entities(value)
    base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)
    upto = 0
    covered = []
    for a, _, b, _ in spans:
        if b > upto:
            covered.append((max(a, upto), b))
            upto = b
    ends = np.array([b for _, b in covered], np.int64)
    told = []
    for i in which.tolist():
        at = int(np.searchsorted(ends, begin[i], "right"))
        if at == len(covered) or covered[at][0] >= end[i]:
            told.append((int(begin[i]), int(end[i]), bool(gone[i])))
    every = sorted([(a, k, b) for a, k, b, _ in spans] + [(a, len(KINDS), b) for a, b, _ in told])
    names = (*KINDS, "term")
    cuts = sorted([(a, b, f"[{KINDS[k].upper()}]") for a, k, b, _ in spans] + [(a, b, "" if out else _general(value[a:b])) for a, b, out in told])
    out, at = [], 0
    for a, b, put in cuts:
        if a >= at:
            out += [value[at:a], put]
        at = max(at, b)
    out.append(value[at:])
    counts = [sum(k == i for _, k, _, _ in spans) for i in range(len(KINDS))]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{names[k]}:{a}:{b}" for a, k, b in every), len(told), sum(o for _, _, o in told), "".join(out))


_OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, n_removed long, clean_text string"


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, sent: int = SENT) -> DataFrame:
    """One row for each row: key, what was found, the spans (code points, end exclusive) and the sanitised text."""
    spark = docs.sparkSession
    telling = disclosing(docs, text, window, support, generalise, remove)
    few = telling.count() <= sent
    kind = docs.schema[key].dataType.simpleString()

    def rows_of(keys: pa.Array, texts: pa.Array, pick) -> pa.RecordBatch:
        made = []
        for i, t in enumerate(texts):
            value = t.as_py() or ""
            raw = np.frombuffer(value.encode(), np.uint8)
            starts, ends, _, h = _terms(raw, np.array([0, len(raw)])) if pick.any_of(i) else (np.zeros(0, np.int64),) * 2 + (None, np.zeros(0, np.uint64))
            which, gone = pick(i, h)
            place = _places(raw) if len(which) else np.zeros(1, np.int64)
            made.append(_row(value, raw, place[starts] if len(which) else starts, place[ends] if len(which) else ends, which, gone))
        names = [c.split()[0] for c in _OUT.split(", ")]
        columns = list(zip(*made, strict=True)) if made else [[]] * len(names)
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [key, *names])

    if few:
        known = sorted(telling.collect())
        table = spark.sparkContext.broadcast((np.array([r.term for r in known], np.int64), np.array([r.remove for r in known], bool)))

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pick = _Pick(*table.value)
            for batch in batches:
                yield rows_of(batch.column(0), batch.column(1), pick)

        return docs.select(key, text).mapInArrow(plain, f"{key} {kind}, {_OUT}")

    # each text that holds telling terms with these: no more of them than it has words
    marks = spark.sparkContext.broadcast(bitmap(telling, "term", BITS))
    held = holding(docs, text, marks, BITS).select("doc", "term").distinct()
    own = held.join(telling, "term").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "remove"))).alias("told"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_hashed((t.as_py() or "").encode()) for t in batch.column(1)], pa.int64())], ["key", "text", "doc"])

    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(hashes, f"key {kind}, text string, doc long").join(own, "doc", "left").select("key", "text", "told.term", "told.remove")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_of(batch.column(0), batch.column(1), _PickOwn(batch.column(2), batch.column(3)))

    return joined.mapInArrow(apart, f"{key} {kind}, {_OUT}")


class _Pick:
    """Which terms of a text disclose, by one table of hashes for all texts."""

    def __init__(self, known: np.ndarray, gone: np.ndarray) -> None:
        order = np.argsort(known.view(np.uint64))
        self.known, self.gone = known.view(np.uint64)[order], gone[order]

    def any_of(self, i: int) -> bool:
        return len(self.known) > 0

    def __call__(self, i: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.flatnonzero(self.known[at] == h), self.gone[at]


class _PickOwn:
    """Which terms of a text disclose, by the hashes that came with each text."""

    def __init__(self, known: pa.Array, gone: pa.Array) -> None:
        self.known, self.gone = known, gone

    def any_of(self, i: int) -> bool:
        return self.known[i].is_valid and len(self.known[i]) > 0

    def __call__(self, i: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.any_of(i):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        return _Pick(np.array(self.known[i].as_py(), np.int64), np.array(self.gone[i].as_py(), bool))(i, h)


def op12_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))
