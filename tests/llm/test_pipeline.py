"""The pipeline's stages, each held against brute force on its own input."""

import collections

import corpus_pipeline
import pytest
from graphloom.llm import quality_classifier

from . import corpus
from .test_operators import brute_components, key


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    made = [r for r in corpus.rows() if r[0] is not None]
    made = made[: made.index(next(r for r in made if r[0] == 1006)) + 1] + [r for r in made if r[0] == 1007]
    docs = spark.createDataFrame([(*r[:5], 1, "x", 2.0) for r in made], "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, n_bytes double")
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 0 if "|" in (r[1] or "") else 1, 0) for r in made]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], folder).write.parquet(f"{tmp_path}/{k}")
        held.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or held[-1].columns == columns
    got = [[r.asDict() for r in d.collect()] for d in held]
    # the classifier rejects the navigation pages and keeps the others
    kept = {r["doc_id"] for r in got[1]}
    assert kept == {r["doc_id"] for r in got[0] if "|" not in (r["text"] or "")}
    # one document of each group stays
    texts = [(r["doc_id"], r["text"] or "") for r in got[1]]
    assert sorted(r["doc_id"] for r in got[2]) == sorted(k for k, _, c in brute_components(texts) if k == c)
    # repeated passages go
    seen: set = set()
    left = {}
    for r in sorted(got[2], key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if b[s : s + 50] in seen:
                gone[s : s + 50] = b"\x01" * 50
        seen.update(b[s : s + 50] for s in range(len(b) - 49))
        left[r["doc_id"]] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {r["doc_id"]: r["text"] for r in got[3]} == left and all(r["n_chars"] == len(r["text"]) for r in got[3])
    # the mix takes documents whole, at most three times
    times = collections.Counter(r["doc_id"] for r in got[4])
    assert set(times) <= set(left) and max(times.values()) <= 3
    # packing keeps every copy
    assert sum(r["start"] == 0 for r in got[5]) == sum(times.values())
    assert key((None,))[0] and quality_classifier.THRESHOLD == 0.7


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
