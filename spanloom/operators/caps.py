"""Caps, top-k and volume estimates over keys and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.plans import blocking as B

S, C = "source1_entity_id", "candidate_entity_id"


def per_entity_cap(pairs: DataFrame, cap: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``cap`` candidates of each S1 record, by candidate id or the order given."""
    w = W.partitionBy(S).orderBy(*(order or [F.col(C)]))
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def kinds_within(rows: DataFrame, cap: int, score: str, down: bool = False) -> DataFrame:
    """Those of ``enriched_kinds``'s rows that can hold one of the ``cap`` best pairs of an S1 record: by ``score``, then by the first id, or the last with ``down``.

    A row's best pair comes before all pairs of the rows after it, so it is in the first ``cap`` rows.
    """
    best = F.desc(F.element_at("__c", -1)) if down else F.element_at("__c", 1)
    rank = F.row_number().over(W.partitionBy(S, "__of").orderBy(F.desc(score), best))
    return rows.withColumn("__k", rank).where(F.col("__k") <= cap).drop("__k")


def volume(s1: DataFrame, rec: DataFrame, plan: list[B.Rule]) -> DataFrame:
    """(rule_idx, volume): pairs that each rule would propose, without making them."""
    a = B.keyed(s1, plan, S).groupBy("rule_idx", "key").agg(F.count("*").alias("a"))
    b = B.key_frequency(rec, plan)
    return a.join(b, ["rule_idx", "key"]).groupBy("rule_idx").agg(F.sum(F.col("a") * F.col("frequency")).alias("volume"))


def pair_frequency(pairs: DataFrame, s1: DataFrame, rec: DataFrame, rule: B.Rule) -> DataFrame:
    """``pairs`` that agree on the rule's keys, with the key's frequency among the records."""
    left, right = B.keyed(s1, [rule], S), B.keyed(rec, [rule], C)
    freq = right.groupBy("key").agg(F.count("*").alias("frequency"))
    return pairs.join(left.select(S, "key"), S).join(right.select(C, F.col("key").alias("other")), C).where("key = other").join(freq, "key").select(S, C, "frequency")


def cap_sweep_metrics(s1: DataFrame, rec: DataFrame, truth: DataFrame, base: list[B.Rule], rule: B.Rule, caps: list[int | None]) -> DataFrame:
    """What a rule adds to the candidates of the plan ``base`` at each cap: added, total, found, recall, precision, mean and 99th percentile of candidates per S1 record."""
    marked = truth.withColumn("is_true", F.lit(1))
    times = truth.groupBy(S, C).agg(F.count("*").alias("m"))
    true = B.among(truth, s1, rec, base).join(times, [S, C]).select(S, (F.col("m") - 1).alias("n0"), F.col("m").alias("t0"))
    old = B.candidate_numbers(s1, rec, base).select(S, F.col("candidates").alias("n0"), F.lit(0).cast("long").alias("t0")).unionByName(true)
    old = old.groupBy(S).agg(F.sum("n0").alias("n0"), F.sum("t0").alias("t0"))
    raw = B.matched(B.keyed(s1, [rule], S), B.keyed(rec, [rule], C)).select(S, C, "key").join(B.key_frequency(rec, [rule]).select("key", "frequency"), "key")
    limits = F.explode(F.array(*(F.lit(c).cast("int") for c in caps))).alias("cap")
    new = raw.join(B.among(raw, s1, rec, base), [S, C], "left_anti").join(marked, [S, C], "left").select(S, "frequency", F.coalesce("is_true", F.lit(0)).alias("hit"), limits).where("cap is null or frequency <= cap")
    new = new.groupBy(S, F.coalesce("cap", F.lit(-1)).alias("at")).agg(F.count("*").alias("n1"), F.sum("hit").alias("t1"))
    grid = s1.select(F.col("entity_id").alias(S), limits).withColumn("at", F.coalesce("cap", F.lit(-1)))
    each = grid.join(old, S, "left").join(new, [S, "at"], "left").fillna(0, ["n0", "t0", "n1", "t1"]).withColumn("n", F.col("n0") + F.col("n1"))
    x = each.groupBy("at").agg(F.max("cap").alias("cap"), F.sum("n1").alias("added"), F.sum("n").alias("total"), F.sum(F.col("t0") + F.col("t1")).alias("found"), F.count("*").alias("s1_records"), F.percentile("n", F.lit(0.99)).alias("p99"))
    x = x.crossJoin(truth.agg(F.count("*").alias("true_pairs")))  # one row
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    return x.select(F.col("cap").cast("long").alias("cap"), "added", "total", "found", ratio("found", "true_pairs").alias("recall"), ratio("found", "total").alias("precision"), ratio("total", "s1_records").alias("mean_candidates"), "p99")


def cap_sweep(s1: DataFrame, rec: DataFrame, truth: DataFrame, rule: B.Rule, caps: list[int | None]) -> DataFrame:
    """(cap, pairs, true_pairs) of a rule for each cap, in one pass; a null cap is none."""
    raw = B.keyed(s1, [rule], S).join(B.keyed(rec, [rule], C), ["rule_idx", "key"]).select(S, C, "key")
    freq = B.key_frequency(rec, [rule]).select("key", "frequency")
    marked = raw.join(freq, "key").join(truth.withColumn("is_true", F.lit(1)), [S, C], "left")
    limits = F.explode(F.array(*(F.lit(c).cast("int") for c in caps)))
    return (
        marked.select(F.coalesce("is_true", F.lit(0)).alias("is_true"), "frequency", limits.alias("cap"))
        .where("cap IS NULL OR frequency <= cap")
        .groupBy("cap")
        .agg(F.count("*").alias("pairs"), F.sum("is_true").alias("true_pairs"))
    )
