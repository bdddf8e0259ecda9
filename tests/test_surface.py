import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom import linkage
from spanloom.functions import keys as K
from spanloom.functions import normalise as N
from spanloom.functions.similarity import matcher_ratio
from spanloom.operators import features, labels, model, output
from spanloom.plans import blocking as B
from spanloom.queries import load
from spanloom.sources import records, store

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, SMALL)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_records_are_keyed_once(spark, tables):
    assert load(spark, SMALL).s1.inputFiles() == tables.s1.inputFiles()


def test_build_records_and_limits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{name}-{i}\tAcme {i} Ltd\t{i} Hill Road\tin\n" for i in range(5)))
    paths = {"S2": str(tmp_path / "a.tsv"), "S3": str(tmp_path / "b.tsv")}
    got = linkage.build_records(spark, paths)
    assert got.count() == 10 and {r["source"] for r in got.collect()} == {"S2", "S3"} and got.first()["country"] == "IN"
    assert linkage.build_records(spark, paths, limit=2).count() == 4


def test_reports_on_blocking(spark, tables, tmp_path):
    t = tables
    got = linkage.evaluate_blocking(t.s1, t.rec, t.truth)
    pairs, truth = set(rows(B.candidates(t.s1, t.rec, B.TEN))), set(rows(t.truth.select("source1_entity_id", "candidate_entity_id")))
    first = got["pairs"].first()
    assert (first["true_pairs"], first["found_pairs"], first["candidate_pairs"]) == (len(truth), len(truth & pairs), len(pairs))
    assert got["rules"].agg(F.sum("new_pairs")).first()[0] == len(pairs)
    assert linkage.blocking_volume(t.s1, t.rec).agg(F.sum("volume")).first()[0] == B.raw_candidates(t.s1, t.rec, B.TEN).count()
    text = output.report("Blocking", got)
    assert "found_pairs: " + str(first["found_pairs"]) in text and text.startswith("Blocking\n========\n")
    output.write_report(text, spark, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report"), wholetext=True).first()[0] == text
    none = {r[0] for r in linkage.diagnose_zero_candidates(t.s1, t.rec).collect()}
    held = {s for s, _ in rows(B.candidates(t.s1, t.rec, B.EIGHT))}
    assert none == {r["entity_id"] for r in t.s1.collect()} - held


def test_candidate_files(spark, tables, tmp_path):
    t = tables
    lists = linkage.candidates_only_match(t.s1, t.rec, str(tmp_path / "m"), str(tmp_path / "c"), B.BASE)
    assert rows(records.read_tsv(spark, str(tmp_path / "m"), records.TRUTH)) == rows(lists)
    got = linkage.evaluate_candidates_file(spark, t.s1, t.truth, str(tmp_path / "c"))
    assert got["pairs"].first()["candidate_pairs"] == B.candidates(t.s1, t.rec, B.BASE).count()
    sweep = output.sweep_lists(t.s1, t.truth.withColumn("score", F.lit(0.5)), [0.3, 0.6])
    output.write_sweep(sweep, str(tmp_path / "s"))
    for threshold in (0.3, 0.6):
        assert rows(records.read_tsv(spark, str(tmp_path / f"s/threshold={threshold}"), records.TRUTH)) == rows(sweep.where(F.col("threshold") == threshold).drop("threshold"))


def plain_heuristic(a, b):
    words = lambda x: set(filter(None, x.split(" ")))
    jaccard = lambda x, y: len(words(x) & words(y)) / len(words(x) | words(y)) if words(x) and words(y) else 0.0
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    number = bool(a["address_number"]) and a["address_number"] == b["address_number"]
    score = 0.32 * ratio(a["name_key"], b["name_key"]) + 0.18 * jaccard(a["name_key"], b["name_key"]) + 0.22 * ratio(a["address_key"], b["address_key"]) + 0.10 * jaccard(a["address_key"], b["address_key"])
    score += 0.08 * number + 0.05 * (a["sorted_name_key"] == b["sorted_name_key"]) + 0.05 * (a["name_key"] == b["name_key"]) + 0.20 * (a["address_key"] == b["address_key"]) + 0.20 * (a["name_key"] == b["name_key"] and number)
    return min(score, 1.0)


def test_heuristic_equals_brute_force(tables, tmp_path):
    t = tables
    pairs = B.candidates(t.s1, t.rec, B.TEN)
    s1, rec = {r["entity_id"]: r for r in t.s1.collect()}, {r["entity_id"]: r for r in t.rec.collect()}
    expected = {(s, c): plain_heuristic(s1[s], rec[c]) for s, c in rows(pairs)}
    got = {(s, c): v for s, c, v in rows(features.heuristic_score(pairs, t.s1, t.rec))}
    assert set(got) == set(expected) and all(abs(got[p] - expected[p]) < 1e-12 for p in got)
    lists = dict(rows(linkage.heuristic_match(t.s1, t.rec, threshold=0.5, max_matches=2)))
    for s in s1:
        best = sorted(((v, c) for (x, c), v in got.items() if x == s and v >= 0.5), reverse=True)[:2]
        assert lists[s] == ",".join(sorted(c for _, c in best))


def test_matcher_ratio_equals_the_standard_library(spark):
    rnd = random.Random(1)
    cases = [("".join(rnd.choices("abc é", k=rnd.randint(0, 250))), "".join(rnd.choices("abc é", k=rnd.randint(0, 250)))) for _ in range(60)] + [("", ""), ("a", "")]
    df = spark.createDataFrame(cases, "a string, b string").withColumn("r", matcher_ratio("a", "b"))
    assert all(r["r"] == SequenceMatcher(None, r["a"], r["b"]).ratio() for r in df.collect())


def test_features_go_on_where_they_stopped(tables, tmp_path):
    t = tables
    pairs = B.candidates(t.s1, t.rec, B.BASE)
    done, real = [], features.pair_features
    first = linkage.build_features(pairs, t.s1, t.rec, str(tmp_path / "f"), 3)
    expected = rows(real(pairs, t.s1, t.rec))
    assert rows(first) == expected
    import shutil

    shutil.rmtree(tmp_path / "f" / "part=1")
    again = store.in_batches(pairs, "source1_entity_id", str(tmp_path / "f"), 3, lambda p: done.append(1) or real(p, t.s1, t.rec))
    assert rows(again) == expected and len(done) == 1


def test_model_and_threshold_round_trip(spark, tables, tmp_path):
    t = tables
    pairs = B.candidates(t.s1, t.rec, B.BASE)
    table = features.pair_features(labels.training_pairs(pairs, t.truth, t.s1, t.rec), t.s1, t.rec)
    fitted = model.train(table, rounds=3)
    linkage.save_artefacts(spark, fitted, 0.4, str(tmp_path / "m"), rounds=3)
    back, known = linkage.load_artefacts(spark, str(tmp_path / "m"))
    assert known == {"threshold": 0.4, "rounds": 3}
    score = lambda m: rows(model.score(m, features.pair_features(pairs, t.s1, t.rec)).select("source1_entity_id", "candidate_entity_id", "score"))
    assert score(back) == score(fitted)
    expected = {}
    for s, c, v in score(fitted):
        if v >= 0.4:
            expected.setdefault(s, []).append(c)
    got = dict(rows(linkage.predict(spark, str(tmp_path / "m"), t.s1, t.rec)))
    assert got == {r["entity_id"]: ",".join(sorted(expected.get(r["entity_id"], []))) for r in t.s1.collect()}


def test_metadata_upsert(spark, tmp_path):
    at = str(tmp_path / "meta")
    store.upsert(spark, at, {"a": "1", "b": "2"})
    store.upsert(spark, at, {"b": "3"})
    assert {r["key"]: r["value"] for r in spark.read.json(at).collect()} == {"a": "1", "b": "3"}


def test_profiles_by_hand(spark):
    """Rows that are written out, so that a wrong constant doesn't pass on both sides."""
    df = spark.createDataFrame([("Acme Foods Private Limited", "12b Long Market Road, Near City Hall, India", "in")], "business_name string, business_address string, country string")
    v1, v2, fast = (K.add_keys(df, p).first() for p in ("v1", "v2", "fast"))
    assert (v1["name_key"], v1["sorted_name_key"], v1["first_name_token"]) == ("acme foods pvt ltd", "acme foods ltd pvt", "acme")
    assert (v2["name_key"], v2["name_token_key"], v2["name_prefix_sig"], v2["name_suffix_sig"]) == ("acme foods", "acme|foods", "acme:5", "oods:5")
    assert (fast["name_key"], fast["address_number"], fast["address_token_sig"]) == ("acme foods", "12b", "marke")
    texts = df.select(N.analysis_name(F.col("business_name")), N.analysis_address(F.col("business_address")), N.display_country(F.lit(" india ")), N.display_country(F.lit("Peru"))).first()
    assert tuple(texts) == ("acme foods pvt ltd", "12b long market rd near city hall india", "India", "Peru")
