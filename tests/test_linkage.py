import itertools
import random

from pyspark.sql import functions as F

from spanloom.functions import keys as K
from spanloom.functions import normalise as N
from spanloom.functions.similarity import common_subsequence
from spanloom.operators import caps, evaluate, labels, output
from spanloom.plans import blocking as B
from spanloom.queries import load
from spanloom.sources import records

SMALL = "/root/testdata/sf0.001"


def records_of(spark, *rows):
    return spark.createDataFrame([(f"S2-{i}", "S2", n, a, c) for i, (n, a, c) in enumerate(rows)], "entity_id string, source string, business_name string, business_address string, country string")


def test_normalise_golden_rows(spark):
    cases = {
        "Société Générale S.A. 12b, rue": "société générale s a 12b rue",
        "प्राइवेट लिमिटेड कंपनी": "प्राइवेट लिमिटेड कंपनी",
        "ＡＢＣ　Co., Ltd.": "abc co ltd",
        "fi ﬁ x": "fi fi x",
        "a b c": "a b c",
        "rue_12 x": "rue 12 x",
        "A+B $5 ™ 🏢 x": "a b 5 tm 🏢 x",
        "Republic Foods Company": "republic foods co",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, y string")
    for given, got, expected in df.select("x", N.normalise(F.col("x")).alias("n"), "y").collect():
        assert got == expected, given
    fast = spark.createDataFrame([("Republic Foods Company",)], "x string").select(N.normalise(F.col("x"), "fast")).first()[0]
    assert fast == "republic foods co".replace("public", "pub")


def test_keys_golden_rows(spark):
    rows = K.add_keys(records_of(spark, ("Ltd Inc", "100a1 7 b", "in"), ("IBM", "१२३ road", "in"), (None, None, None), ("Acme Acme Foods Ltd", "12b Long Market Road", "us")))
    got = {r["entity_id"]: r for r in rows.collect()}
    assert [got["S2-0"][k] for k in ("name_key", "sorted_name_key", "name_token_key", "first_name_token", "name_prefix_sig")] == [""] * 5
    assert got["S2-0"]["address_number"] == "7" and got["S2-1"]["address_number"] == "१२३"
    assert all(got["S2-2"][k] == "" for k in K.KEYS)
    x = got["S2-3"]
    assert (x["name_key"], x["sorted_name_key"], x["name_token_key"]) == ("acme acme foods", "acme acme foods", "acme|foods")
    assert (x["name_prefix_sig"], x["name_suffix_sig"], x["address_token_sig"], x["address_number"]) == ("acme:10", "oods:10", "marke", "12b")
    fast = K.add_keys(records_of(spark, ("Ltd Inc", "", "in")), "fast").first()
    assert fast["name_key"] == "ltd inc"
    for profile in ("v1", "base", "diagnose"):
        assert K.add_keys(records_of(spark, ("IBM", "5 Hill", "in")), profile).first()["name_key"] == "ibm"


def test_rules_equal_a_cross_join(spark):
    t = load(spark, SMALL)
    s1, rec = t.s1.collect(), t.rec.collect()
    for rule in (B.EVERY_RULE[2], B.EVERY_RULE[13], B.EVERY_RULE[6]):
        expected = {(a["entity_id"], b["entity_id"]) for a, b in itertools.product(s1, rec) if a["country"] == b["country"] and all(a[k] and a[k] == b[k] for k in rule.keys)}
        assert {tuple(r) for r in B.candidates(t.s1, t.rec, [rule]).collect()} == expected


def test_union_ignores_order_and_caps_are_monotone(spark):
    t = load(spark, SMALL)
    pairs = lambda plan: {tuple(r) for r in B.candidates(t.s1, t.rec, plan).collect()}
    assert pairs(B.TEN) == pairs(B.TEN[::-1])
    sizes = [len(pairs([B.Rule(("first_name_token", "address_token_sig"), c)])) for c in (1, 3, 10, None)]
    assert sizes == sorted(sizes)
    swept = {r["cap"]: r["pairs"] for r in caps.cap_sweep(t.s1, t.rec, t.truth, B.Rule(("first_name_token", "address_token_sig")), [1, 3, 10, None]).collect()}
    assert [swept.get(c, 0) for c in (1, 3, 10, None)] == sizes
    estimate = caps.volume(t.s1, t.rec, B.TEN).agg(F.sum("volume")).first()[0]
    assert estimate == B.raw_candidates(t.s1, t.rec, B.TEN).count()


def test_common_subsequence_equals_dynamic_programme():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        return row[-1]

    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choices("abcd é", k=rnd.randint(0, 90))) for _ in range(2))
        assert common_subsequence(a, b) == plain(a, b)
    assert common_subsequence("acme corp", "acme co") == 7 and common_subsequence("kitten", "sitting") == 4


def test_split_is_one_for_all(spark):
    t = load(spark, SMALL)
    x = t.s1.select("entity_id", labels.fold(F.col("entity_id")).alias("f"), labels.is_training(F.col("entity_id")).alias("t")).collect()
    assert all((r["f"] < 80) == r["t"] for r in x) and 0 < sum(r["t"] for r in x) < len(x)


def test_metrics_hand_computed(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    pair = "source1_entity_id string, candidate_entity_id string"
    truth = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b"), ("S1-2", "c")], pair)
    picked = spark.createDataFrame([("S1-1", "a"), ("S1-2", "z")], pair)
    got = {r["source1_entity_id"]: (r["precision"], r["recall"], r["f_half"]) for r in evaluate.entity_scores(s1, picked, truth).collect()}
    assert got == {"S1-1": (1.0, 0.5, 0.625 / 0.75), "S1-2": (0.0, 0.0, 0.0), "S1-3": (1.0, 1.0, 1.0)}
    assert {tuple(r) for r in output.match_lists(s1, picked).collect()} == {("S1-1", "a"), ("S1-2", "z"), ("S1-3", "")}
    counts = evaluate.count_percentiles(spark.createDataFrame([(i,) for i in range(10)], "candidates long")).first()
    assert (counts["p50"], counts["p50_cumulative"], counts["p50_index"], counts["p50_floor"]) == (4.5, 4, 4, 5)


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "source1.tsv"
    path.write_text("﻿entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme Ltd\t1 Hill\tin \nS1-2\t\t\tus\n", encoding="utf-8")
    df = records.read_records(spark, str(path), "S1")
    assert {(r["entity_id"], r["name_key"], r["country"]) for r in df.collect()} == {("S1-1", "acme", "IN"), ("S1-2", "", "US")}
    truth = spark.createDataFrame([("S1-1", " S2-1, S2-2 ,,S2-1"), ("S1-2", ""), ("", "S2-9")], records.TRUTH)
    assert {tuple(r) for r in records.explode_truth(truth).collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-2")}
    records.write_tsv(truth, str(tmp_path / "out"))
    assert records.read_tsv(spark, str(tmp_path / "out"), records.TRUTH).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    from spanloom.streaming.incremental import link_stream

    t = load(spark, SMALL)
    raw = t.entities.where("source = 'S1'").select("entity_id", "business_name", "business_address", "country")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link_stream(arriving, t.rec, B.BASE, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("source1_entity_id", "candidate_entity_id")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in B.candidates(t.s1, t.rec, B.BASE).collect()}


def test_trees_learn(spark):
    from spanloom.queries import QUERIES

    rows = QUERIES["gbt_evaluation"](spark, SMALL).collect()
    assert len(rows) == 9 and max(r["macro_f_half"] for r in rows) > 0.5
