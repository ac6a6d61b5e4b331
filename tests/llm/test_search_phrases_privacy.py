"""Operators 11 to 13 against brute force, on odd texts."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import corpus

TEXTS = [(r[0], r[1], r[2]) for r in corpus.rows()]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, "the river, the WIND"), (2, None), (2, "日本語 é"), (3, "nothing such"), (None, "Ships wait"), (4, ""), (1, "tide"), (5, " ".join(f"w{i}" for i in range(30)) + " mills"), (6, "the of a " * 500)]


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


# --- 11 ranked lexical search -------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    of = [(key, collections.Counter(terms(text))) for key, text in docs]
    of = [(key, c, sum(c.values())) for key, c in of if c]
    n_docs, n_terms = len(of), sum(n for _, _, n in of)
    df = collections.Counter(t for _, c, _ in of for t in c)
    asked = collections.defaultdict(set)
    for key, text in items:
        asked[key] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for key, c, n in of:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"k": 7, "block": 40}])
def test_search_matches_brute_force(spark, options):
    from graphloom.llm.lexical_search import search

    items = spark.createDataFrame([(*x, 1.0, "x") for x in ITEMS], "item_id long, text string, score double, doc_id string")
    got = sorted((tuple(r) for r in search(corpus.frame(spark), items, **options).collect()), key=str)
    assert got == brute_search([x[:2] for x in TEXTS], ITEMS, options.get("k", 50))


def test_search_ties_over_many_tiles(spark, monkeypatch):
    from graphloom.llm import lexical_search

    monkeypatch.setattr(lexical_search, "TERMS", 3)
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    docs = [(i * 7 % 3001, "same words here" if i % 3 else f"same {i % 5}") for i in range(3001)]
    items = [(i, t) for i, t in enumerate(["same", "words here same", "here", "0 1 2 3 4 same words here"])]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 50)


def test_search_of_nothing(spark):
    from graphloom.llm.lexical_search import search

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(corpus.empty(spark), items).count() == 0
    assert search(corpus.frame(spark), items.limit(0)).count() == 0
    assert search(spark.createDataFrame([(1, None), (2, "-")], "doc_id long, text string"), items).count() == 0


def test_impacts_past_64_bits():
    from graphloom.llm.lexical_search import impact

    tf, n = np.array([3, 5]), np.array([2**31 - 1, 10])
    assert impact(tf, n, 10**12, 10**15).tolist() == [1_000_000_000 * t // (1000 * t + 20 * (50 + 50 * x * 10**12 // 10**15)) for t, x in zip(tf.tolist(), n.tolist())]


# --- 12 personal data ---------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    from graphloom.llm.privacy import entities

    rng = random.Random(4)
    pieces = ["a", "B.", "@", "@@", ".", "-", "x.y", "1", "23", "256", "1.2.3.4", "+", "+1 ", "(", ")", " ", "  ", "\n", "4111 1111 1111 1111", "4111-1111-1111-1111", "555-0100", "é", "😀", "%", "_", "192.168.000.1", "٣", "，"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert [(a, k, b) for a, k, b, _ in entities(text)] == brute_spans(text), text


def test_base_spans_take_linear_time():
    import time

    from graphloom.llm.privacy import entities

    began = time.time()
    for text in ("a" * 400_000 + "@", "a@" * 200_000, "1" * 400_000, "1." * 200_000, "+1" + "-" * 400_000, "1 " * 200_000, "a@b-" * 100_000, "+1(" * 100_000):
        entities(text)
    assert time.time() - began < 20


def brute_terms(texts, window=8, support=2, generalise=0.95, remove=1.0):
    """The terms that disclose an entity, with whether they are removed."""
    different = sorted({t or "" for t in texts})
    near, df_e, df_t = collections.Counter(), collections.Counter(), collections.Counter()
    for text in different:
        df_t.update(set(terms(text)))
        spans = brute_spans(text)
        places = [(m.start(), m.end(), m.group().translate(SMALL)) for m in TERM.finditer(text)]
        free = [p for p in places if not any(p[1] > a and p[0] < b for a, _, b in spans)]
        found = set()
        for a, k, b in spans:
            value = (k, text[a:b].lower() if k == 0 else text[a:b] if k == 1 else re.sub("[^0-9]", "", text[a:b]))
            found.add((value, None))
            left, right = [p for p in places if p[1] <= a][-window:], [p for p in places if p[0] >= b][:window]
            found |= {(value, p[2]) for p in left + right if p in free}
        df_e.update(v for v, t in found if t is None)
        near.update(x for x in found if x[1] is not None)
    out = {}
    for (value, term), both in near.items():
        ic = math.log(len(different) / df_e[value])
        pmi = math.log(both * len(different) / (df_e[value] * df_t[term]))
        if both >= support and ic > 0 and pmi / ic >= generalise - 1e-9:
            out[term] = out.get(term, False) or pmi / ic >= remove - 1e-9
    return out


def people():
    rng = random.Random(9)
    fill = lambda n: " ".join(rng.choice(corpus.WORDS) for _ in range(n))
    rows = [(i, fill(20)) for i in range(100, 700)]
    for i in range(6):
        rows.append((i, f"{fill(9)} Marlowe Quill wrote from m.q@mail.example.org about case 77812 {fill(12)}"))
    rows += [(20, f"{fill(6)} Marlowe Quill was seen {fill(5)} 77812"), (21, f"Only Zanzibar {fill(3)} +44 (0) 1632 960001 {fill(4)}"), (22, f"{fill(4)} Zanzibar, +44 (0) 1632 960001 😀 {fill(9)}")]
    rows += [(30, None), (31, ""), (32, rows[600][1]), (None, rows[601][1]), (32, rows[600][1]), (40, "4111 1111 1111 1111, " * 3 + fill(30))]
    return rows


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_sanitised_texts_match_brute_force(spark, sent):
    from graphloom.llm.privacy import sanitise

    rows = people()
    told = brute_terms([t for _, t in rows])
    assert "quill" in told and "zanzibar" in told and "the" not in told
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, entity int").repartition(3)
    want = []
    for key, text in rows:
        text = text or ""
        base = brute_spans(text)
        more = [(m.start(), 4, m.end()) for m in TERM.finditer(text) if m.group().translate(SMALL) in told and not any(m.end() > a and m.start() < b for a, _, b in base)]
        names = ("email", "ip", "card", "phone", "term")
        line = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want.append((key, *[sum(k == i for _, k, _ in base) for i in range(4)], hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + more)), len(more)))
    got = sanitise(made, sent=sent).collect()
    assert sorted((tuple(r[:8]) for r in got), key=str) == sorted(want, key=str)
    clean = {r.doc_id: r.clean_text for r in got}
    assert "Quill" not in clean[20] and "m.q@" not in clean[0] and "[EMAIL]" in clean[0] and "[CARD], [CARD], [CARD]" in clean[40] and clean[30] == "" and clean[100] == rows[0][1]


def test_sanitise_nothing(spark):
    from graphloom.llm.privacy import sanitise

    assert sanitise(corpus.empty(spark)).count() == 0
    assert [r.spans for r in sanitise(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")).collect()] == ["email:0:5"]


# --- 13 phrases ---------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top, longest=4):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    most = collections.Counter()
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                most[q] = max(most[q], a)
    out = collections.defaultdict(list)
    for p, a in found.items():
        if p in most and 100 * most[p] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, q.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, q, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("options", [{"least": 2, "top": 2000}, {"least": 3, "top": 5, "shard": 50}, {"least": 2, "top": 9, "longest": 2}, {"least": 5, "top": 100, "longest": 3, "bits": 15, "shard": 1000}])
def test_phrases_match_brute_force(spark, options):
    from graphloom.llm.collocations import mine

    rows = [(t, (None, "en", "und", "é")[i % 4]) for i, (_, t, _) in enumerate(TEXTS) if t is None or len(t) < 100_000]
    made = spark.createDataFrame([(t, x, 1, "y") for t, x in rows], "text string, lang string, label int, a string").repartition(4)
    want = brute_phrases(rows, options["least"], options["top"], options.get("longest", 4))
    assert sorted(tuple(r) for r in mine(made, **options).collect()) == want and len(want) > 8


def test_phrases_of_nothing(spark):
    from graphloom.llm.collocations import mine

    assert mine(corpus.empty(spark)).count() == 0
    assert mine(spark.createDataFrame([(None, None), ("", "en"), ("a b a b", "en")], "text string, lang string"), least=3).count() == 0


def test_automata_share_states_and_add_up():
    from graphloom.llm.collocations import Automaton, union

    rng = random.Random(2)
    total, parts = collections.Counter(), []
    for _ in range(5):
        c = collections.Counter()
        for _ in range(300):
            path = tuple(rng.randrange(6) for _ in range(4))
            for k in range(1, 5):
                c[path[:k]] += 1
        total += c
        levels = [sorted(p for p in c if len(p) == k) for k in range(1, 5)]
        place = [{p: i for i, p in enumerate(x)} for x in levels]
        parents = [np.array([place[k - 1][p[:-1]] if k else 0 for p in x]) for k, x in enumerate(levels)]
        made = Automaton.built(np.arange(6, dtype=np.uint64) * np.uint64(3), parents, [np.array([p[-1] for p in x]) for x in levels], [np.array([c[p] for p in x]) for x in levels])
        assert made.size() < len(c)  # states that are alike are one
        parts.append(Automaton.from_bytes(made.to_bytes()))
    for all_ in (union(parts), union([union(parts[:2]), union(parts[2:])])):
        parents, labels, weights = all_.paths()
        paths, found = [()], {}
        for k in range(4):
            paths = [(*paths[p], int(all_.names[x]) // 3) for p, x in zip(parents[k], labels[k], strict=True)]
            found |= dict(zip(paths, weights[k].tolist(), strict=True))
        assert found == dict(total)


def test_ranges_of_hot_words_are_cut():
    from graphloom.llm.collocations import range_of

    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    a[1000:3000] = a[1000]
    b = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    order = np.lexsort((b, a))
    got = range_of(a[order], b[order], 4, a[1000:1001], np.array([40]))
    assert (np.diff(got) >= 0).all() and len(np.unique(got[a[order] == a[1000]])) == 40


def test_bitmap(spark):
    from graphloom.llm.common import bitmap, bits_set

    values = [0, 1, -1, 2**40 + 5, -(2**63), 32767, 32768]
    marks = bitmap(spark.createDataFrame([(v,) for v in values], "x long"), "x", 16)
    asked = np.arange(1 << 16, dtype=np.uint64)
    assert set(np.flatnonzero(bits_set(marks, asked, 16)).tolist()) == {v % (1 << 16) for v in values} and marks.nbytes == 8192
    assert not bitmap(spark.range(0), "id", 10).any()


def test_queries_match_brute_force(spark, tmp_path):
    """The registered queries on one folder: op11 and op13 by brute force, op12's digests by its own spans."""
    from graphloom.llm import registry

    corpus.frame(spark).withColumn("text", F.substring("text", 1, 20_000)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 2) for x in ITEMS], "item_id long, text string, rank int").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(k, None if t is None else t[:20_000], x) for k, t, x in TEXTS]
    got = [tuple(r) for r in registry.QUERIES["op11_lexical_search"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_search([x[:2] for x in texts], ITEMS, 50)
    got = [tuple(r) for r in registry.QUERIES["op13_collocations"](spark, str(tmp_path)).collect()]
    assert sorted(got) == brute_phrases([x[1:] for x in texts], 30, 2000)
    got = registry.QUERIES["op12_privacy"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((k is None, k or 0) for k, _, _ in texts)
    assert {r.n_email + r.n_ip + r.n_card + r.n_phone for r in got} == {0} and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
