"""Candidates and their numbers where ids are repeated and keys are hot."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.keys import KEYS
from spanloom.operators import features, labels
from spanloom.plans import blocking as B

S, C = B.S, B.C


@pytest.fixture(scope="module")
def tables(spark):
    """S1 and records with few values of each key, blank and null ones, and repeated ids."""
    rnd = random.Random(2)

    def made(source, n, ids):
        rows = [(f"{source}-{rnd.randrange(ids)}", source, rnd.choice(["EN", "FR", None]), *(rnd.choice(["a", "b", "c", "", None]) for _ in KEYS)) for _ in range(n)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("entity_id", "source", "country", *KEYS)))
        return df.join(df.groupBy("entity_id").agg((F.count("*") > 1).alias("repeated")), "entity_id").cache()

    return made("S1", 60, 90), made("S2", 80, 150)


def pairs_of(df):
    return sorted((r[S], r[C]) for r in df.collect())


def test_answers_from_keys_equal_those_from_pairs(tables, monkeypatch):
    monkeypatch.setattr(B, "PART", 3)
    s1, rec = tables
    plain = pairs_of(B.candidates(s1.drop("repeated"), rec.drop("repeated"), B.BASE))
    assert len(plain) == len(set(plain)) > 300
    assert pairs_of(B.candidates(s1, rec, B.BASE)) == plain
    counts = {}
    for s, _ in plain:
        counts[s] = counts.get(s, 0) + 1
    assert {r[S]: r["candidates"] for r in B.candidate_numbers(s1, rec, B.BASE).collect()} == counts
    assert {r[S] for r in B.proposed(s1, rec, B.BASE).collect()} == set(counts)
    truth = s1.select(F.col("entity_id").alias(S)).crossJoin(rec.select(F.col("entity_id").alias(C))).where(F.xxhash64(S, C) % 5 == 0)
    asked = {tuple(r) for r in truth.collect()}
    assert pairs_of(B.among(truth, s1, rec, B.BASE)) == [p for p in plain if p in asked]
    scores = lambda df: sorted((r[S], r[C], r["n"]) for r in df.select(S, C, features.block_score().alias("n")).collect())
    pairs = B.candidates(s1, rec, B.BASE)
    assert scores(features.enriched(s1, rec, B.BASE)) == scores(features.enrich(pairs, s1, rec))
    drawn = labels.training_pairs(pairs, truth, s1, rec).groupBy("label").count().collect()
    sums = labels.plan_balance(B.BASE, truth, s1, rec).agg(F.sum("positives"), F.sum("negatives")).first()
    assert {r["label"]: r["count"] for r in drawn} == {1: sums[0], 0: sums[1]}


def test_a_hot_key_is_dealt_and_its_pairs_are_counted_unmade(spark):
    row = lambda source: spark.range(3000).select(F.concat(F.lit(source), F.col("id").cast("string")).alias("entity_id"), F.lit("EN").alias("country"), F.lit(False).alias("repeated"), *(F.lit("k").alias(k) for k in KEYS))
    s1, rec = row("a"), row("b")
    numbers = B.candidate_numbers(s1, rec, B.BASE)
    assert {r["candidates"] for r in numbers.collect()} == {3000}
    joined = B.matched(B.keyed(s1, B.BASE[:1], S), B.keyed(rec, B.BASE[:1], C))
    tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 9_000_000 and max(r["count"] for r in tasks) < 9_000_000
