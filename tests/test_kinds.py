"""Queries on pairs work on kinds of records, and give the same rows as pair by pair."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom import queries
from spanloom.functions import similarity as sim
from spanloom.functions.keys import KEYS
from spanloom.operators import caps, evaluate, features, labels, output
from spanloom.plans import blocking as B

S, C = B.S, B.C


@pytest.fixture(scope="module")
def tables(spark):
    """S1 and records with few values of each key, blank and null ones, copies and repeated ids."""
    rnd = random.Random(3)

    def made(source, n, ids):
        rows = [(f"{source}-{rnd.randrange(ids)}", source, rnd.choice(["EN", "FR", None]), *(rnd.choice(["a b", "b ca", "", None]) for _ in KEYS)) for _ in range(n)]
        rows += [(f"{source}-{1000 + i}", source, "EN", *(f"copy {source if k == 'address_key' else ''}" for k in KEYS)) for i in range(40)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("entity_id", "source", "country", *KEYS)))
        return df.join(df.groupBy("entity_id").agg((F.count("*") > 1).alias("repeated")), "entity_id").cache()

    s1, rec = made("S1", 60, 90), made("S2", 80, 150)
    truth = s1.select(F.col("entity_id").alias(S)).crossJoin(rec.select(F.col("entity_id").alias(C))).where(F.xxhash64(S, C) % 7 == 0).distinct()
    return queries.Tables(s1, rec, truth.cache(), None)


@pytest.fixture
def plain(tables):
    """The candidates as they are found pair by pair."""
    return sorted(map(tuple, B.candidates(tables.s1.drop("repeated"), tables.rec.drop("repeated"), B.BASE).collect()))


@pytest.mark.parametrize("shared", [3, 256])
def test_candidate_files_pair_kinds(tables, plain, monkeypatch, shared):
    monkeypatch.setattr(output, "SHARED", shared)
    made, real = [], B.candidates
    monkeypatch.setattr(B, "candidates", lambda *a: made.append(real(*a).count()) or real(*a))
    assert list(map(tuple, queries.candidate_file_long(tables).collect())) == plain
    assert sum(made) < len(plain) / 1.5
    lists = {}
    for s, c in plain:
        lists.setdefault(s, []).append(c)
    made.clear()
    got = sorted(map(tuple, queries.candidate_file_wide(tables).collect()))
    assert got == sorted((r["entity_id"], ",".join(lists.get(r["entity_id"], []))) for r in tables.s1.collect())
    assert sum(made) < len(plain) / 1.5


def scores(df):
    return sorted((r[S], r[C], round(r["score"], 12)) for r in df.select(S, C, "score").collect())


def test_heuristics_score_kinds_once(tables, monkeypatch):
    monkeypatch.setattr(features, "SHARED", 3)
    expected = scores(features.heuristic_score(B.candidates(tables.s1, tables.rec, B.BASE), tables.s1, tables.rec))
    assert scores(queries.heuristic_scores(tables)) == expected
    rows = features.plan_heuristic(tables.s1, tables.rec, B.BASE)
    assert rows.count() < len(expected) / 1.5
    best, got = {}, {}
    for s, c, v in sorted(expected, key=lambda x: (x[2], x[1]), reverse=True):
        best.setdefault(s, []).append((v, c))
    for s, c, v in scores(features.each_pair(caps.kinds_within(rows, 4, "score", down=True), "score")):
        got.setdefault(s, []).append((v, c))
    assert {s: sorted(v, reverse=True)[:4] for s, v in got.items()} == {s: v[:4] for s, v in best.items()}


def test_negatives_and_sweeps_of_kinds(tables, monkeypatch):
    monkeypatch.setattr(features, "SHARED", 3)
    pairs = B.candidates(tables.s1, tables.rec, B.BASE)
    rows = lambda df: sorted((r[S], r["rn"], r["block_score"], r[C]) for r in df.collect())
    args = (tables.truth, tables.s1, tables.rec, 2, 5)
    assert rows(labels.plan_negatives(B.BASE, *args)) == rows(labels.hard_negatives(pairs, *args))
    kinds = features.enriched_kinds(tables.s1, tables.rec, B.BASE).withColumn("score", features.block_score() / 9)
    each = features.enrich(pairs, tables.s1, tables.rec).withColumn("score", features.block_score() / 9)
    hits = features.enrich(B.among(tables.truth, tables.s1, tables.rec, B.BASE), tables.s1, tables.rec).withColumn("score", features.block_score() / 9)
    sweep = lambda *x: sorted(map(tuple, evaluate.entity_sweep(tables.s1, x[0], tables.truth, queries.THRESHOLDS, *x[1:]).collect()))
    assert sweep(evaluate.reached(kinds, queries.THRESHOLDS), hits) == sweep(each)


def test_ratios_of_many_pairs_equal_those_of_one():
    rnd = random.Random(4)
    text = lambda letters, most: "".join(rnd.choices(letters, k=rnd.randint(0, most)))
    for letters, most in (("ab", 12), ("abc é", 70), ("abcdefghij klmnop", 140), ("abc é", 260), ("".join(map(chr, range(0x900, 0xB00))), 90)):
        a = [text(letters, most) for _ in range(150)]
        b = [text(letters, most) if i % 3 else x[: len(x) // 2] + text(letters, 3) + x[len(x) // 2 :] for i, x in enumerate(a)]
        for many, one in ((sim._indel, sim._ratio), (sim._matcher, lambda x, y: SequenceMatcher(None, x, y).ratio())):
            assert sim._batch(many, one, pa.array(a), pa.array(b)).to_pylist() == [one(x, y) for x, y in zip(a, b, strict=True)]
