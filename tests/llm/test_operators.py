import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import corpus
from .test_bytetext import counting

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).cache()


TEXTS = [(r[0], r[1] or "") for r in corpus.rows()]


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


# --- 1 quality rules ----------------------------------------------------------------------------------------------


def test_quality_counts_match_brute_force(spark, docs):
    from graphloom.llm.quality_rules import clean

    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in clean(docs).collect()), key=key)
    want = []
    for k, t in TEXTS:
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want, key=key)


def test_quality_verdicts(spark):
    from graphloom.llm.quality_rules import clean

    good = ". ".join(" ".join(f"w{i}{j}" for j in range(8)) for i in range(12)) + "."
    shout = "\n".join(" ".join(f"W{i}X{j}!!".upper() for j in range(10)) for i in range(8))
    bar = "\n".join(" | ".join(f"w{i}{j}" for j in range(10)) for i in range(8))
    made = spark.createDataFrame([(1, good), (2, shout), (3, bar), (4, good + "\nAll rights reserved."), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.clean_text) for r in clean(made).collect()}
    assert [got[i][0] for i in range(1, 6)] == [True, False, False, True, False]
    assert got[4][1] == good and got[5][1] == ""


def brute_verdict(text):
    """The rules, line by line, in Python: (lost share, kept, clean text)."""
    import regex

    from graphloom.llm.quality_rules import BOILERPLATE, ENDS

    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    fragment = [len(WORD.findall(x)) <= 4 and x.rstrip(" \t\v\f\r")[-1] not in ENDS for x in lines]
    kept = []
    for i, x in enumerate(lines):
        w = WORD.findall(x)
        n = len(w)
        low = x[:80].lower()
        rest = regex.sub(r"^[^\p{L}\p{N}©(]{0,3}", "", low) if regex.match(r"[^\p{L}\p{N}©(]{1,3}[\p{L}\p{N}©(]", low) else low
        phrase = any(rest.startswith(p) and not (rest[len(p) : len(p) + 1].isalnum()) for p in BOILERPLATE) or regex.match(r"(?:copyright\s+)?(?:©|\(c\))|copyright\s+\d{4}", rest)
        left = re.sub(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1(?=[\x20\x09-\x0D]|$)){4,}", "", x)
        bad = (
            sum(any(c in "#*$%&|<>" for c in v) for v in w) > 0.2 * n
            or sum(v.endswith(("!!", "??", "!?")) for v in w) > 0.2 * n
            or sum(bool(regex.fullmatch(r"[|/\\\\•·›»~–—*+=<>-]{1,3}", v)) for v in w) > 0.2 * n
            or (n >= 4 and not regex.search(r"\p{Ll}", x) and bool(regex.search(r"\p{Lu}", x)))
            or len(left) < 0.8 * len(x)
            or (n <= 15 and bool(phrase))
            or any(all(0 <= j < len(lines) and fragment[j] for j in range(i + f, i + f + 4)) for f in range(-3, 1))
        )
        if not bad:
            kept.append(x)
    size = lambda ls: sum(len(v) for x in ls for v in WORD.findall(x))
    lost = 1 - size(kept) / size(lines) if size(lines) else 0.0
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return round(lost, 9), not failed and lost <= 0.5, "\n".join(kept)


def test_quality_verdicts_match_brute_force(spark, docs):
    from graphloom.llm.quality_rules import clean

    prose = lambda i: " ".join(f"word{i}{j}" for j in range(12)) + "."
    odd = [
        "JavaScript is a language for the web.", "Cookies are baked in an oven.", "We use cookies to improve the site", "© 2020 Someone", "Copyright 2021 Someone", "Copyright law is old.",
        "Home", "News", "Contact us", "About", "", "One • two • three", "a | b | c", "WHO SHOUTS LIKE THIS", "really!! now!! stop!!", "Lire la suite", "Weiterlesenswert ist es", "– Read more", "no no no no no no",
        "x #a *b", "Short", "Line", "ends here.", "Not", "a", "menu",
    ]
    texts = [t for _, t in TEXTS if len(t) < 100_000] + ["\n".join([prose(i) for i in range(6)] + odd), "\n".join(odd * 4), "\n".join(x + "\n" + prose(i) for i, x in enumerate(odd))]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (round(r.lost_share, 9), r.kept, r.clean_text) for r in clean(made).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_verdict(t), t[:300]


def test_quality_query_clashing_columns(spark, tmp_path):
    """The registered query gives one row for each row, whatever its other columns are named."""
    from graphloom.llm.quality_rules import op1_quality_rules

    corpus.frame(spark).withColumns({"n_words": F.lit("x"), "kept": F.lit("y"), "_lines": F.lit(1), "line": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_quality_rules(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.kept) for r in got) == sorted((k is None, k or 0, len(WORD.findall(t)), brute_verdict(t)[1]) for k, t in TEXTS)


# --- 2 HTML extraction --------------------------------------------------------------------------------------------

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/a>Home</a></nav>{extra}<article><h1>Title {i}</h1><p>First &amp; <b>bold {i}<p>Second\n  line<br>end</article><div class='comments'>Nice</div><footer>&copy; me</footer>"


def test_html_main_text(spark):
    from graphloom.llm.html_extraction import extract

    pages = [(i, f"http://h.example/{i}", PAGE.format(i=i, extra="<div>Follow our channel</div>")) for i in range(12)] + [(100, None, None), (101, "nonsense", ""), (102, "http://x.example/", "<p>Only <i>text"), (102, "http://x.example/", "<p>Only <i>text")]
    got = extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(pages)
    assert by[3] == "Title 3\nFirst & bold 3\nSecond line end"
    assert by[100] == by[101] == "" and by[102] == "Only text"


def test_html_template_by_recurrence(spark):
    from graphloom.llm.html_extraction import extract

    body = "<html><body><div><p>Own words of page {i}.</p></div><div><span>Best deals of the week</span></div></body>"
    pages = [(i, "http://h.example/x", body.format(i=i)) for i in range(20)] + [(50, "http://other.example/", body.format(i=50))]
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in extract(made).collect()}
    assert by[4] == "Own words of page 4."
    assert by[50] == "Own words of page 50.\nBest deals of the week"
    assert {r.page_id: r.text for r in extract(made, broadcast_hashes=0).collect()} == by
    assert extract(made.limit(0)).count() == 0


def test_html_copies_and_sections(spark):
    """A page copied on a fifth of its host keeps its text; a template of a section goes whatever its share."""
    from graphloom.llm.html_extraction import extract

    own = "<body><h1>Site</h1><article><div class=body><p>Own words of page {i}, long enough.</p></div></article>{x}</body>"
    copy = "<body><article><div class=body><p>Words that are copied.</p><p>And more of them.</p></div></article></body>"
    bare = "<body><div><p>Bare words that are copied.</p></div></body>"
    pages = [(i, "http://h.example/", own.format(i=i, x="")) for i in range(15)] + [(i, "http://h.example/", copy) for i in range(15, 22)] + [(i, "http://h.example/", bare) for i in range(22, 30)]
    quoted = "<body><article><div class=body><p>Shared by several pages.</p></div><div class=x><span>Site news</span></div><p>Own {i}</p></article></body>"
    pages += [(100 + i, "http://q.example/", quoted.format(i=i)) for i in range(12)]
    section = "<body><div><p>Text of {i}</p></div>{x}</body>"
    pages += [(1000 + i, "http://s.example/", section.format(i=i, x="<div><span>From our section</span></div>" if i < 12 else "")) for i in range(100)]
    by = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert by[3] == "Own words of page 3, long enough."
    assert by[16] == "Words that are copied.\nAnd more of them."
    assert by[25] == "Bare words that are copied."
    assert by[104] == "Shared by several pages.\nOwn 4"
    assert by[1005] == "Text of 5" and by[1050] == "Text of 50"


def text_of(html, templates=frozenset()):
    from graphloom.llm.html_extraction import hashed, main_text, tree

    root = tree(html)
    hashed(root)
    return main_text(root, templates)


def test_html_deep_and_broken():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    wrapped = "<div class='has-sidebar'><article><div class='post-header'><h1>T</h1></div><p>a<div class='share-bar'>x</div></article><div class=sidebar>y</div></div><div class='site-header'>z</div>"
    assert text_of(wrapped) == "T\na"
    assert text_of("<script>var x='<p>no</p>'</script><p>yes</div></p><ul><li>a<li>b</ul>") == "yes\na\nb"
    assert text_of("<![foo[ x ]]><p>a</p><![CDATA[b]]><!doctype [<!x>]><p>c") == "a\n]>\nc"


def test_html_never_fails():
    """Any mix of pieces of markup has a text."""
    rng = np.random.default_rng(6)
    parts = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "<?", "?>", "</", "/>", "<p", " a='", '"', "&", "&#", "&#x110000;", "&amp", "<script>", "</script ", "<style", "<article>", "x y", "<!DOCTYPE", "[", "CDATA[", "<a href=/>", "\ud800", "\x00", "<table><tr>", "if", "endif"]
    for _ in range(3000):
        assert isinstance(text_of("".join(rng.choice(parts, int(rng.integers(1, 12))))), str)


def test_html_long_references():
    assert text_of("<p>&#" + "5" * 5000 + ";a") == "\ufffda" and text_of("<p>&#" + "0" * 5000 + "65;") == "A" and text_of("&#x" + "f" * 9000 + ";&#x0000000041;") == "\ufffdA"
    assert text_of("<p title='&#" + "9" * 6000 + "'>&amp;&#65 &lt;b&notin;&#128512;") == "&A <b∉😀"


def test_html_takes_linear_time():
    """Twice the page takes about twice the time, whatever it is made of."""
    import time

    makers = [
        lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<a " * n, lambda n: "<div class=share-bar>" * n + "<article>x", lambda n: "<!--" * n, lambda n: "<a href='" * n,
        lambda n: "<p " * n + ">", lambda n: "&#" * n, lambda n: "<li>" * n, lambda n: "<div>" * n + "<p>a" * n, lambda n: "</p>" * n, lambda n: "<div class='" + "menu " * n + "'>x", lambda n: "<table><tr><td>" * n, lambda n: "<" * n,
    ]
    for make in makers:
        took = []
        for n in (20_000, 40_000):
            page, runs = make(n), []
            for _ in range(2):
                began = time.process_time()
                text_of(page)
                runs.append(time.process_time() - began)
            took.append(min(runs))
        assert took[1] < 3.2 * took[0] + 0.2 and took[1] < 10, (make(2), took)


def test_html_names_are_judged_whole():
    page = "<nav>Home</nav><article><h1>T</h1><section id='social-history'><p>How people lived.</p></section><div class='share-bar'>Tweet</div><section class='comment-list'><p>Nice!</p></section></article>"
    assert text_of(page) == "T\nHow people lived."
    report = "<body><div class='share-price-report'><h2>Shares</h2><p>They rose by a third in the year.</p></div><div class='cookie-notice'><p>We use cookies</p></div></body>"
    assert text_of(report) == "Shares\nThey rose by a third in the year."
    assert text_of("<body><div class='promo'><h2>All</h2><p>The page is in a block of this name.</p></div><div class='promo'><p>Buy</p></div></body>") == "All\nThe page is in a block of this name."


def test_html_recurrence_decides_where_kinds_do_not(spark):
    """On the pages themselves, with nothing but recurrence to go by, templates are what is taken away."""
    from graphloom.llm.html_extraction import extract

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    text = lambda **options: {r.page_id: (r.text, r.n_templates) for r in extract(pages, **options).collect()}
    none, some, both = text(kinds=False, few_pages=10**9, min_pages=10**9), text(kinds=False), text()
    assert not any(n for _, n in none.values()) and sum(n > 0 for _, n in both.values()) > 0.2 * len(both)
    moved = sum(some[k][0] != none[k][0] for k in none)
    assert moved > 0
    assert sum(len(some[k][0]) for k in some) < sum(len(none[k][0]) for k in none)


def test_html_without_marks(spark):
    """Where divs stand for the elements that say what they are, nearly all pages have the same text, and recurrence decides some of them."""
    from graphloom.llm.html_extraction import extract

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(?:nav|ul|li|article|h1|footer|div)\b[^>]*>", "<$1div>"))
    text = lambda made, **options: {r.page_id: " ".join(r.text.split()) for r in extract(made, **options).collect()}
    want, got, off = text(pages), text(bare), text(bare, few_pages=10**9, min_pages=10**9)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert sum(got[k] == want[k] for k in want) > sum(off[k] == want[k] for k in want)


# --- 3 Jaccard join -----------------------------------------------------------------------------------------------


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    part = list(range(len(texts)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    least = {}
    for members in groups.values():
        keys = [texts[i][0] for i in members if texts[i][0] is not None]
        for i in members:
            least[i] = min(keys) if keys else None
    return sorted(((texts[i][0], len(sets[i]), least[i]) for i in range(len(texts))), key=key)


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 300, "broadcast_rows": 0}])
def test_jaccard_matches_brute_force(docs, options):
    from graphloom.llm.jaccard_join import near_duplicates

    made = near_duplicates(docs, count=True, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made), key=key) == brute_components(TEXTS)
    sets = [shingles(t) for _, t in TEXTS]
    n = [sum(180 * len(a & b) >= 80 * (len(a) + len(b)) for j, b in enumerate(sets) if j != i and a and b) for i, a in enumerate(sets)]
    assert sorted((r.doc_id or -1, r.n_links) for r in made) == sorted((k or -1, x) for (k, _), x in zip(TEXTS, n, strict=True))
    plain = near_duplicates(docs, **options)
    assert "n_links" not in plain.columns and sorted(((r.doc_id, r.n_shingles, r.component_id) for r in plain.collect()), key=key) == brute_components(TEXTS)


def test_jaccard_empty(spark):
    from graphloom.llm.jaccard_join import near_duplicates

    assert near_duplicates(corpus.empty(spark)).count() == 0


def test_prefix_tree_finds_all_links():
    from graphloom.llm.jaccard_join import PrefixTree, joining_links

    rng = np.random.default_rng(3)
    base = [rng.choice(500, 60, replace=False) for _ in range(4)]
    sets = []
    for i in range(80):
        s = base[i % 4].copy()
        m = int(rng.integers(0, 12))
        s[:m] = rng.integers(1000, 2000, m)
        sets.append(np.unique(s).astype(np.uint64))
    tree = PrefixTree(sets)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))}
        assert set(tree.linked(i, 80)) == want
    assert len(joining_links(sets, 80)) < len(sets)


def test_pairs_belong_to_their_first_group():
    """Counts over groups add up to all links once, whatever groups sets share and however groups are cut."""
    from graphloom.llm.jaccard_join import counted_links, settled_before

    rng = np.random.default_rng(8)
    base = rng.choice(500, 60, replace=False)
    sets = []
    for _ in range(40):
        s = base.copy()
        m = int(rng.integers(0, 12))
        s[:m] = rng.integers(1000, 2000, m)
        sets.append(np.unique(s).astype(np.uint64))
    owners = [np.unique(np.append(rng.choice([3, 5, 7, 9], 2), 7)) for _ in sets]  # all are in group 7
    weights = rng.integers(1, 4, len(sets))
    want = np.array([sum(weights[j] for j, b in enumerate(sets) if j != i and 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))) for i, a in enumerate(sets)])
    for cut in (np.zeros(40, int), np.arange(40) % 2):
        n = np.zeros(len(sets), np.int64)
        for group in (3, 5, 7, 9):
            for one, two in [(0, 0), (1, 1), (0, 1)] if cut.any() else [(0, 0)]:
                at = [i for i, o in enumerate(owners) if group in o and cut[i] in (one, two)]
                n[at] += counted_links([sets[i] for i in at], weights[at], cut[at], 80, group, [owners[i] for i in at])[1]
        assert (n == want).all()
    assert settled_before(9, [np.array([3, 9]), np.array([3, 5, 9])]) and not settled_before(9, [np.array([3, 9]), np.array([5, 9])])


# --- 4 suffix dedup -----------------------------------------------------------------------------------------------


def brute_cut(texts, length=50):
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    seen, out, i = set(), {}, 0
    while i < len(order):
        same = [j for j in order[i:] if texts[j][0] == texts[order[i]][0]]
        for j in same:
            b = texts[j][1].encode()
            gone = bytearray(len(b))
            for s in range(len(b) - length + 1):
                if b[s : s + length] in seen:
                    gone[s : s + length] = b"\x01" * length
            kept = bytes(x for x, g in zip(b, gone) if not g)
            spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
            out[j] = (texts[j][0], len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
        for j in same:
            b = texts[j][1].encode()
            seen.update(b[s : s + length] for s in range(len(b) - length + 1))
        i += len(same)
    return sorted(out.values(), key=key)


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot": 3, "bucket_bytes": 900, "block_bytes": 300, "doc_bytes": 4000}, {"bucket_bytes": 6000, "block_bytes": 3000, "doc_bytes": 4000}])
def test_suffix_dedup_matches_brute_force(docs, options):
    from graphloom.llm.suffix_dedup import dedup

    made = dedup(docs, **options)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made.collect()), key=key)
    assert got == brute_cut(TEXTS)


def test_suffix_dedup_long_text_and_carry(spark):
    from graphloom.llm.suffix_dedup import dedup

    rng = np.random.default_rng(5)
    long = "".join(chr(97 + c) for c in rng.integers(0, 26, 2_200_000))
    part = long[2_090_000:2_100_000]
    rows = [(1, long, "a"), (2, "0" * 30 + part + "1" * 30, "b"), (3, "z" * 500, "c")]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=True, carry=("lang",)).collect()}
    assert got[1].n_removed == 0 and got[2].kept == "0" * 30 + "1" * 30 and got[2].lang == "b" and got[3].n_removed == 0
    assert dedup(corpus.empty(spark)).count() == 0


def test_suffix_dedup_compares_bytes(spark):
    """Two texts of one run each, with one gram, whose runs' hashes have their upper 32 bits in common; runs with equal hashes and other bytes."""
    from graphloom.llm.suffix_dedup import Runs, dedup, leads

    texts = ["fnzhfpbciqcdsrfrrbfakvlyebntuwgldkkxtenkobamgzqaga", "izsuyqfymnufeasssbadfmmlhuoyfmqumykxtenkobamgzqaga"]
    runs = Runs(np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, 50, 100]), 50, 16)
    assert runs.sample[0] == runs.sample[1] and runs.whole[0] != runs.whole[1] and runs.whole[0] >> np.uint64(32) == runs.whole[1] >> np.uint64(32)
    got = {r.doc_id: r.n_removed for r in dedup(spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[1])], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    assert leads(data, np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2]), np.zeros(4, np.uint64), np.array([2, 3, 1, 1])).tolist() == [2, 1, 2, 3]


def test_difference_cover():
    """Cover suffixes are in order, and every suffix that repeats is found, however long the tie."""
    from graphloom.llm.suffix_dedup import COVER, PERIOD, Pieces, cover_order, suffixes_that_go

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 99, 700), np.full(300, 120), rng.integers(97, 101, 500)]).astype(np.uint8)
    p, order, common = cover_order(np.concatenate([text, np.zeros(58, np.uint8)]), 50)
    padded = text.tobytes() + bytes(58)
    strings = [padded[x : x + 50] for x in p[order].tolist()]
    assert strings == sorted(strings)
    for a, b, n in zip(strings, strings[1:], common[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (n == 50 or a[n] != b[n])
    size = np.array([90, 90, 60, 300, 300])
    begin = np.array([0, 3, 30, 650, 720])
    data = np.concatenate([text[b : b + s] for b, s in zip(begin, size, strict=True)])
    at = np.cumsum(size) - size
    key = np.array([5, 4, 9, 7, 8])
    run, suffix = suffixes_that_go(Pieces(data, at, size, *np.zeros((4, 5), np.uint64), key, np.arange(5), np.zeros(5, np.int64), np.zeros(5, np.int64)), 50)
    least = {}
    windows = [(k, w, data[at[k] + w : at[k] + w + 50].tobytes()) for k in range(5) for w in range(size[k] - 49)]
    for k, _, b in windows:
        least[b] = min(least.get(b, 99), key[k])
    assert set(zip(run.tolist(), suffix.tolist(), strict=True)) == {(k, w) for k, w, b in windows if key[k] > least[b]}


def test_suffix_dedup_refuses_other_keys(spark):
    from graphloom.llm.suffix_dedup import dedup

    with pytest.raises(TypeError):
        dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- 5 sharding ---------------------------------------------------------------------------------------------------


def test_sharding(docs, spark):
    from graphloom.llm.sharding import shard

    got = shard(docs, 4).collect()
    assert len(got) == len(TEXTS)
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = collections.defaultdict(list)
    for k, t in TEXTS:
        text[k].append(t)
    placed = collections.defaultdict(set)
    for r in got:
        placed[text[r.doc_id][0] if r.doc_id is not None else None].add(r.shard)
        if r.doc_id is not None:
            t = text[r.doc_id][0]
            assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert all(len(s) == 1 for t, s in placed.items() if t is not None)
    assert shard(corpus.empty(spark)).count() == 0


def test_differencing_is_tight_by_levels(spark):
    from graphloom.llm.sharding import shard_groups

    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 10_000, 4000).tolist()
    groups = spark.createDataFrame([(bytes(hashlib.md5(str(i).encode()).digest()), s) for i, s in enumerate(sizes)], "digest binary, bytes long")
    sums = collections.Counter()
    for r in shard_groups(groups, 8, per_task=100, per_level=7).join(groups, "digest").collect():
        sums[r.shard] += r.bytes
    assert sum(sums.values()) == sum(sizes) and max(sums.values()) - min(sums.values()) < 1e-5 * sum(sizes) / 8


# --- 6 fingerprints -----------------------------------------------------------------------------------------------


def test_fingerprints_match_brute_force(spark):
    from graphloom.llm.fingerprints import as_hex, fingerprints, search, term_hashes

    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.doc_id: r.h for r in made.select("doc_id", term_hashes(F.col("text")).alias("h")).collect()}
    second = {r.h: r.h1 for r in made.select(F.explode(term_hashes(F.col("text"))).alias("h")).distinct().withColumn("h1", F.xxhash64("h")).collect()}
    got = {r.doc_id: r.f for r in fingerprints(made, ["doc_id"]).select("doc_id", as_hex(F.col("f0"), F.col("f1")).alias("f")).collect()}
    for i, h in terms.items():
        bits = ""
        for half in (h, [second[x] for x in h]):
            word = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in half) > len(half))
            bits += f"{word:016x}"
        assert got[i] == bits
    made = fingerprints(made, ["doc_id"])
    all_ = {r.doc_id: int(got[r.doc_id], 16) for r in made.collect()}
    found = {(r.query, r.found, r.distance) for r in search(made.where("doc_id % 7 = 0"), made).collect()}
    assert found == {(a, b, (x ^ y).bit_count()) for a, x in all_.items() if a % 7 == 0 for b, y in all_.items() if (x ^ y).bit_count() <= 6}


def test_op6_edits(spark, tmp_path):
    from graphloom.llm.fingerprints import op6_fingerprints

    rows = {i: t for i, (_, t) in enumerate(TEXTS)}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in op6_fingerprints(spark, str(tmp_path)).collect()}
    for a, i in enumerate(ids):
        t, nxt = rows[i], rows[ids[(a + 1) % len(ids)]]
        m = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert got[i].near_next == pytest.approx(1 - (int(got[i].fingerprint, 16) ^ int(got[ids[(a + 1) % len(ids)]].fingerprint, 16)).bit_count() / 128)


def test_op6_repeated_and_null_ids(spark, tmp_path):
    """Each row gives one row, whatever ids are repeated or null."""
    from graphloom.llm.fingerprints import op6_fingerprints

    rows = [(1, "one two three")] * 4 + [(2, "a b c d"), (2, "d c b a"), (2, "b b b b")] + [(None, "x y z"), (None, "z y x"), (None, "x y z")] + [(i, f"text {i} of more words") for i in range(5, 25)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = sorted((r for r in rows if r[0] is not None), reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1], reverse=True)
    got = op6_fingerprints(spark, str(tmp_path)).collect()
    of = {}
    want = []
    for (i, t), (_, nxt) in zip(known, known[1:] + known[:1], strict=True):
        m = len(t) // 3
        want.append((i or -1, hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest(), t, nxt))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted(w[:2] for w in want)
    by = {w[:2]: w for w in want}
    for r in got:
        of[by[r.doc_id or -1, r.edited_sha256][2]] = int(r.fingerprint, 16)
    assert of["a b c d"] != of["d c b a"] and len(set(of.values())) == len(of)
    for r in got:
        _, _, t, nxt = by[r.doc_id or -1, r.edited_sha256]
        assert int(r.fingerprint, 16) == of[t] and r.near_next == pytest.approx(1 - (of[t] ^ of[nxt]).bit_count() / 128)
        assert r.n_near is None


def test_op6_counts_near_rows(spark, tmp_path):
    """Queries are the rows whose id is divisible by 100, copies of them too; other rows within 6 bits are counted, with copies."""
    from graphloom.llm.fingerprints import block_keys, op6_fingerprints

    base = " ".join(f"word{i}" for i in range(300))
    rows = [(i, base if i % 3 else base.replace(f"word{i % 290}", "other", 1)) for i in range(0, 330, 5)] + [(100, base), (100, "alone"), (None, base), (200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, int(r.fingerprint, 16), r.n_near) for r in op6_fingerprints(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    for k, f, n in got:
        want = sum((f ^ g).bit_count() <= 6 for _, g, _ in got) - 1
        assert n == (want if k is not None and k % 100 == 0 else None)
    assert any(n and n > 10 for _, _, n in got)
    one = spark.range(1).select(block_keys(F.lit(-1).cast("long"), F.lit(5).cast("long"), 3, 7).alias("b")).first().b
    assert len(one) == len(set(one)) == 35


# --- 7 WARC -------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    from graphloom.llm.warc import archive, read_records

    big = "é" * 700
    pages = [(1, "http://a", big), (2, "http://b", big), (3, "http://c", "small"), (4, "http://d", "small"), (5, None, None), (6, "http://e\r\n", "x\r\n\r\n" * 3000), (None, "u", "null key"), (2, "http://b", big)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    for chunk in (1 << 20, 300):
        got = sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or "") for r in read_records(archive(made, chunk_bytes=chunk)).collect())
        want = sorted(
            (f"urn:page:{'' if k is None else k}", "revisit" if k == 1 else "response", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "urn:page:2" if k == 1 else "") for k, _, h in pages
        )
        assert got == want
    assert read_records(archive(made.limit(0))).count() == 0


# --- 8 classifier -------------------------------------------------------------------------------------------------


def test_classifier_held_out_accuracy(spark):
    from graphloom.llm.quality_classifier import op8_quality_classifier

    sf = "/root/testdata/sf0.01"
    got = op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_classifier_odd_input(spark, docs):
    from graphloom.llm.quality_classifier import fit

    one = fit(spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "x", None)], "doc_id long, text string, label int"))
    assert all(r.s > 0.99 for r in docs.select(one.score(F.col("text")).alias("s")).collect())
    none = fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r.s for r in docs.select(none.score(F.col("text")).alias("s")).collect()} == {0.5}


# --- 9 packing ----------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm.packing import pack

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((k, tuple([*t.encode(x, add_special_tokens=False).ids, 1])) for k, x in TEXTS)
    got = pack(docs, size=64).collect()
    windows = collections.defaultdict(dict)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        windows[r.sequence_id][r.offset] = r
    flat = []
    for q in sorted(windows):
        at = 0
        for o in sorted(windows[q]):
            assert o == at
            at += windows[q][o].length
            flat.append(windows[q][o])
        assert at == 64 or q == max(windows)
    built, seen = [], collections.Counter()
    for r in flat:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        if r.start == 0:
            built = []
        assert r.start == len(built)
        built += ids
        if len(built) == r.doc_tokens:
            seen[r.doc_id, tuple(built)] += 1
    assert seen == want and sorted(windows) == list(range(len(windows)))
    assert pack(corpus.empty(spark)).count() == 0


def test_packing_in_small_rows(spark, docs):
    from graphloom.llm.packing import pack

    texts = {k: t for k, t in TEXTS if k is not None and k != 1006}
    some = docs.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != 1006))
    whole, cut = ({}, {})
    for into, most in ((whole, 1 << 22), (cut, 700)):
        for r in pack(some, most=most).collect():
            into.setdefault(r.doc_id, []).append(r)
    assert set(whole) == set(cut) == set(texts)
    for k in texts:
        one, two = (sorted(x[k], key=lambda r: r.start) for x in (whole, cut))
        assert b"".join(r.ids for r in one) == b"".join(r.ids for r in two)
        for rows in (one, two):
            assert [r.start for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))] and {r.doc_tokens for r in rows} == {sum(r.length for r in rows)}


def test_words_that_count_bits(spark):
    """Words that polynomials modulo 2 ** 64 can't tell apart are different for the join and for packing."""
    from graphloom.llm.jaccard_join import near_duplicates
    from graphloom.llm.packing import pack
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = [w for bits in (10, 11) for w in counting(bits)]
    made = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(made).collect()) == [(i, i) for i in range(4)]
    got = {}
    for r in sorted(pack(made).collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert got == {i: [*tokenizer.encode(w, add_special_tokens=False).ids, 1] for i, w in enumerate(words)}


# --- 10 mixing ----------------------------------------------------------------------------------------------------


def test_mixing_targets_and_copies(spark):
    from graphloom.llm.mixing import emit, mix

    rows = [(i, " ".join(["w"] * (1 + i % 50)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 4000 + ["c"] * 4000 + ["d"] * 4000 + [None] * 2000)] + [(90_000, None, "b")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(made).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = {r.source: r.target for r in got}
    assert target["a"] == pytest.approx(3 * size["a"])
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert target["d"] / target["c"] == pytest.approx(5) and target["b"] / target["c"] == pytest.approx(2) and target[None] / target["c"] == pytest.approx(2)
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    for s, x in target.items():
        assert abs(taken[s] - x) < 0.1 * x
    assert sorted(map(str, got)) == sorted(map(str, mix(made.repartition(7)).collect()))
    assert emit(mix(made)).count() == sum(r.copies for r in got) and emit(mix(made)).columns == made.columns
    assert mix(corpus.empty(spark)).count() == 0 and mix(corpus.frame(spark)).count() == len(TEXTS)


def test_mixing_query_is_near_its_targets(spark):
    """Each source of the whole table takes words within 3 in 100 of its target; draws are as likely for each document."""
    from graphloom.llm.mixing import op10_mixing

    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = collections.Counter()
    for s, n in docs.values():
        size[s] += n
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    taken, twice = collections.Counter(), collections.Counter()
    for r in got:
        s, n = docs[r.doc_id]
        assert r.size == n and r.source_size == size[s] and r.target == pytest.approx(3 * size[s] if s in capped else weight[s] * level)
        taken[s] += r.taken
        assert r.taken == r.copies * n <= 3 * n
        rate = r.target / r.source_size
        assert r.copies in (math.floor(rate + 1e-9), math.floor(rate) + 1)
        twice[n > 300] += r.copies - rate
    for s in names:
        assert abs(taken[s] - (3 * size[s] if s in capped else weight[s] * level)) < 0.03 * taken[s]
    assert all(abs(x) < 0.05 * len(docs) for x in twice.values())


def test_mixing_many_sources_and_clashes(spark):
    """Sources joined by a shuffle, a hot one among them; columns that the operator uses itself are replaced or carried along."""
    from graphloom.llm.mixing import mix

    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 40}", 5, "c", "n") for i in range(900)] + [(None, "w", None, 5, "c", "n")] * 2
    made = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string, target string").withColumns({"rows": F.lit("r"), "last": F.lit("l"), "whole": F.lit("w")})
    few, many = mix(made), mix(made, broadcast_rows=0)
    assert few.columns == many.columns == ["doc_id", "text", "source", "rows", "last", "whole", "size", "source_size", "target", "copies", "taken"]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == len(rows)
    assert {r["rows"] for r in few.select(few.columns[3]).collect()} == {"r"}


def test_mixing_all_empty(spark):
    from graphloom.llm.mixing import mix

    got = mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2 and not any(math.isnan(r.target) for r in got)
