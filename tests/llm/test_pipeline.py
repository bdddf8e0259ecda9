import os
import re

import corpus_pipeline
import pytest
from spanloom.llm import decontaminate, quality, secrets
from spanloom.llm.common import stage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        out.append((name, docs, docs := stage(step(spark, docs, SF), "test")))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(results):
    assert [n for n, _, _ in results] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for _, given, kept in results[:4]:
        assert kept.schema.names == given.schema.names and kept.dtypes == given.dtypes


def test_quality_keeps_good_documents(spark, results):
    _, given, kept = results[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts(given), texts(kept)
    assert all(after[i] == before[i] for i in after)
    good, bad = [i for i in before if labels.get(i) == 1], [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.3 * len(bad)


def test_one_document_of_each_class(results):
    from test_near_dedup import brute

    _, given, kept = results[1]
    assert set(texts(kept)) == {i for i, _, c in brute(sorted(texts(given).items())) if i == c}


def test_no_benchmark_item_is_left(spark, results):
    _, given, kept = results[2]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(given), texts(kept)
    held = {i for i, t in before.items() if any(x in t for x in items)}
    assert held and not held & set(after)
    found = {r["doc_id"] for r in decontaminate.find_leaks(given, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(before) - set(after) == found


def test_secrets_are_replaced_and_nothing_else(results):
    from test_text_scans import plain_base

    _, given, kept = results[3]
    before, after = texts(given), texts(kept)
    assert set(before) == set(after)
    assert any("[assign]" in t for t in after.values())
    for i, t in after.items():
        assert not plain_base(t)
        if not plain_base(before[i]):
            assert re.sub(r"\[pair_\w+\]", "", t) == t and t == before[i] or "[pair_" in t
    for r in kept.collect():
        assert r["n_chars"] == len(r["text"])


def test_every_document_is_packed(results):
    _, given, packed = results[4]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts(given))


def test_odd_documents_pass_every_stage(docs):
    long = "word other " * 20_000
    d = docs(None, "", "x", "x", None, long, long, "password=hunter2222 x", ids=[1, 2, 3, 3, None, 5, 6, 7], extra=True)
    columns = d.schema
    for name, step in corpus_pipeline.STAGES[1:]:
        d = stage(step(d.sparkSession, d, "/root/testdata/sf0.001"), "odd")
        if name != "best-fit packing":
            assert d.schema.names == columns.names
    assert sorted({str(r["doc_id"]) for r in d.collect()}) == ["1", "2", "3", "5", "7", "None"]


def test_odd_documents_pass_the_quality_stage(spark, docs):
    d = docs(None, "", "x", "x", None, "word " * 300_000, ids=[1, 2, 3, 3, None, 5], extra=True)
    kept = corpus_pipeline.quality_filter(spark, d.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True), "/root/testdata/sf0.001")
    assert kept.columns == d.columns and kept.count() > 100


def test_empty_tables_pass_every_stage(spark, docs):
    d = docs("x", extra=True).where("false")
    for _, step in corpus_pipeline.STAGES:
        d = stage(step(spark, d, "/root/testdata/sf0.001"), "empty")
        assert d.count() == 0


def test_run_leaves_one_table(spark):
    from spanloom.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and len(set(os.listdir(root)) - before) == 1


def test_filters_keep_the_rest(docs):
    d = docs("a", None, "c", "d", ids=[1, None, 3, 3])
    assert quality.keep(d, quality.Model(__import__("numpy").zeros(quality.BUCKETS, "float32"), 5.0), 0.3).count() == 4
    assert secrets.redact(d.where("false")).count() == 0
