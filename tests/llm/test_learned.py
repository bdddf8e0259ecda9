import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality
from spanloom.llm.neighbours import centres, enough_visits, filed, learn, nearest, unit, visits
from spanloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_features_stay_inside_their_text():
    texts = ["abc", "", "a b", "é x" * 50, "  spaced  out "]
    together = quality.features(texts)
    for t, got in zip(texts, together, strict=True):
        assert [x.tolist() for x in got] == [x.tolist() for x in quality.features([t])[0]]
    assert len(together[1][0]) == 0


def test_features_are_words_pairs_and_grams():
    text = "the cat  sat\non the mat mat mat"
    words = text.split()
    plain = Counter(words) + Counter("same" if a == b else (a, b) for a, b in zip(words[:-1], words[1:], strict=True))
    for n in quality.GRAMS:
        for w in words:
            w = f" {w} "
            plain += Counter(f"#{w[i : i + n]}" for i in range(len(w) - n + 1))
    ids, counts = quality.features([text])[0]
    assert sorted(counts.tolist()) == sorted(plain.values())


def test_long_texts_are_taken_in_pieces(docs, monkeypatch):
    model = quality.Model(np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32), 0.0)
    text = "lorem ipsum dolor sit amet " * 4000
    whole, one = quality.features([text])[0], model.score([text, "x"])
    monkeypatch.setattr(quality, "PIECE", 1000)
    ids, counts = quality.features([text])[0]
    assert set(ids) == set(whole[0]) and abs(int(counts.sum()) - int(whole[1].sum())) <= len(text) // 900
    assert np.allclose(model.score([text, "x"]), one, atol=1e-3)
    assert sum(len(p) for _, held in quality.pieces(["y" * 5000]) for p in held) == 5000
    assert quality.score(docs("z" * 3_000_000, text), model).count() == 2


def test_scores_do_not_depend_on_the_batch():
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.5)
    texts = ["one two", "", "three " * 400, "x"]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])
    assert model.score([""])[0] == pytest.approx(1 / (1 + np.exp(-0.5)))


def test_fit_without_both_labels():
    assert quality.fit([], np.array([])).score(["x"])[0] == pytest.approx(0.5)
    assert quality.fit(quality.bags(["a", "b"]), np.array([1, 1])).score(["x"])[0] > 0.5


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_subword_quality"](spark, SF).collect()}
    assert len(rows) == 1000
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) >= 0.93
    assert np.mean([rows[i]["predicted"] for i in held if labels[i] == 1]) >= 0.97


def test_labels_with_nulls_and_repeats(spark, docs):
    d = docs("good words here", "BAD!! BAD!!", None, "", "good words there", extra=True)
    marks = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, label int")
    got = quality.score(d, quality.train(d, marks)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(d.where("false"), quality.train(d, marks.where("false"))).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), unit(np.array([r[1] for r in rows], np.float64))
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, shortlist=100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        best = np.lexsort((ids, -s))[:5]
        hit += len({v for v, _ in got[ids[q]].values()} & set(ids[best].tolist()))
        for v, score in got[ids[q]].values():
            assert score == pytest.approx(s[np.searchsorted(ids, v)], abs=1e-12)
        assert sorted(got[ids[q]]) == [1, 2, 3, 4, 5]
    assert hit / (5 * len(got)) >= 0.95


def test_unusable_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, "x"), (2, [], "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (7, [1.0, 2.0, 3.0], "x"), (None, [1.0, 0.0], "x")]
    good = [(0, [1.0, 0.0], "x"), (8, [2.0, 0.0], "x"), (9, [3.0, 0.0], "x"), (10, [0.0, 1.0], "x"), (50, [0.0, -1.0], "x"), (50, [0.0, -1.0], "x")]
    got = sorted(tuple(r) for r in nearest(vectors(spark, bad + good), F.col("vec_id") % 50 == 0).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 8), (0, 2, 9), (0, 3, 10), (0, 4, 50), (50, 1, 0), (50, 2, 8), (50, 3, 9), (50, 4, 10)]
    assert nearest(vectors(spark, bad[:6]), F.col("vec_id") % 50 == 0).count() == 0


def test_a_large_group_of_copies_hides_nothing(spark):
    """A third of the rows is one vector: queries near it still find the rows beyond."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(900, 16))
    x[rnd.permutation(900)[:300]] = x[0]
    x[150:156] = x[0] + rnd.normal(size=(6, 16)) * 0.3
    got = {}
    for r in nearest(vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, shortlist=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = unit(x.astype(np.float32).astype(np.float64))
    hit = 0
    for q in range(0, 900, 50):
        s = np.round(x @ x[q], 12)
        s[q] = -2
        best = np.lexsort((np.arange(900), -s))[:5]
        hit += len({v for _, v, _ in got[q]} & set(best.tolist()))
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert hit >= 0.95 * 5 * 18


def test_visits_hold_the_neighbours():
    x = unit(np.random.default_rng(6).normal(size=(3000, 16)))
    books = learn(x, books=4, words=32)
    codes, _ = books.encode(x)
    for two in (False, True):
        middle, own = centres(books, two), filed(codes, 32, two)
        n = enough_visits(x, codes, books, two, 5)
        assert 1 <= n < len(middle)
        lists = visits(x[:200], middle, n)
        near = x[:200] @ x.T
        near[np.arange(200), np.arange(200)] = -2
        best = np.argsort(-near, axis=1)[:, :5]
        assert np.mean([own[b] in set(r) for r, bs in zip(lists.tolist(), best.tolist(), strict=True) for b in bs]) >= 0.95


def test_beam_is_no_worse_than_greedy():
    x = unit(np.random.default_rng(2).normal(size=(600, 16)))
    books = learn(x, books=4, words=16)
    error = {}
    for beam in (1, 8):
        codes, norms = books.encode(x, beam)
        back = sum(books.words[m][codes[:, m]] for m in range(4))
        assert np.allclose(np.linalg.norm(back, axis=1), norms, atol=1e-4)
        error[beam] = ((x - back) ** 2).sum()
    assert error[8] <= error[1]
