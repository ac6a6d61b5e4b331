"""The registered queries themselves: one row for each row on odd tables, none on empty ones."""

import collections
import hashlib
import zlib

import pytest
from graphloom.llm import registry

from . import corpus
from .test_operators import brute_components, brute_cut, key

PAGES = [(1, "http://h.example/a", "<article><p>Some words.</p></article>"), (2, None, None), (2, "http://h.example/b", "<![x[ <p>broken"), (None, "nonsense", ""), (4, "http://h.example/c", "é" * 700), (5, "http://h.example/d", "é" * 700)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for name in ("odd", "empty"):
        at = tmp_path_factory.mktemp(name)
        rows = [] if name == "empty" else corpus.rows()
        spark.createDataFrame(rows, corpus.SCHEMA).write.parquet(f"{at}/documents.parquet")
        pages = spark.createDataFrame([] if name == "empty" else [(*p, 7, "x") for p in PAGES], "page_id long, url string, html string, text int, host string")
        pages.write.parquet(f"{at}/pages.parquet")
        labels = [(r[0], int("|" not in (r[1] or "")), 0) for r in rows if r[0] is not None and r[0] % 2]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        made[name] = str(at)
    return made


#: Those with a row for each row, or pieces of each; reports are in test_search_phrases_privacy.py.
BY_ROW = sorted(set(registry.QUERIES) - {"op11_lexical_search", "op13_collocations"})


@pytest.mark.parametrize("name", BY_ROW)
def test_rows_in_are_rows_out(spark, folders, name):
    got = registry.QUERIES[name](spark, folders["odd"]).collect()
    assert registry.QUERIES[name](spark, folders["empty"]).count() == 0
    texts = [(r[0], r[1] or "") for r in corpus.rows()]
    ids = sorted(p[0] or -1 for p in PAGES) if name[:3] in ("op2", "op7") else sorted(-1 if k is None else k for k, _ in texts)
    column = "page_id" if name[:3] in ("op2", "op7") else "doc_id"
    if name == "op9_packing":  # pieces: each document's ids lie in exactly one
        assert sum(r.start == 0 for r in got) == len(texts) and {-1 if r.doc_id is None else r.doc_id for r in got} == set(ids)
        return
    assert sorted(-1 if r[column] is None else r[column] for r in got) == ids
    if name == "op3_jaccard_join":
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == brute_components(texts)
    elif name == "op4_suffix_dedup":
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == brute_cut(texts)
    elif name == "op5_sharding":
        of = collections.Counter((k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts)
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == of and {r.law for r in got} <= {"bytes", "rows", "key"}
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    elif name == "op7_warc":
        of = collections.Counter((k, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in PAGES)
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == of
        assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {4: 5}
    elif name == "op2_html_extraction":
        assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got}[1] == "Some words."
