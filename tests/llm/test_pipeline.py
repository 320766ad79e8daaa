"""The pipeline's stages on a small table, each against what its operator decides."""

import re

import pytest

import corpus_pipeline
from histomesh.llm import queries

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs):
    at = str(tmp_path_factory.mktemp("tables"))
    marked = docs.sparkSession.createDataFrame([(9000, "geda kibe dagi me@mail.example.com begi daka kabe", "aa", "s1", 50, "x", 1)], docs.schema)
    docs.union(marked).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages_follow_each_other(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    letters = {i for i, t, *_ in texts if t and re.search(r"[^\W\d_]", t)} | {9000}
    assert set(ids["language"]) == letters
    assert set(ids["near_dedup"]) < letters and not {1000 + k for k in range(15)} & set(ids["near_dedup"])
    assert sorted(ids["personal"]) == sorted(ids["near_dedup"])
    clean = {r["doc_id"]: r for r in kept["personal"]}
    assert "[EMAIL]" in clean[9000]["text"] and "@" not in clean[9000]["text"]
    assert all(len(r["text"]) == r["n_chars"] for r in kept["personal"])
    assert set(ids["mixing"]) <= set(ids["personal"]) and max(map(ids["mixing"].count, set(ids["mixing"]))) <= 2
    tokens = sum(r["length"] for r in kept["packing"])
    once = {(r["doc_id"]): r["doc_tokens"] for r in kept["packing"]}
    assert tokens == sum(once[i] for i in ids["mixing"])


def test_near_dedup_keeps_one_of_repeated_rows(spark, odd):
    rows = corpus_pipeline.near_dedup(spark, odd, "").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "None", "None"]


def test_stages_on_no_and_odd_rows(spark, none, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        stage(spark, odd, "").count()


def test_fourteen_queries_are_registered():
    import __spark_entry__ as repo

    names = [n for n in repo.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 14 and set(queries.SQL) <= set(queries.QUERIES)
