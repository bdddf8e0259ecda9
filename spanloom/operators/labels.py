"""Training pairs: positives, ranked hard negatives, and one split for all uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import caps
from spanloom.operators import features as X
from spanloom.plans import blocking as B

S, C = X.S, X.C


def positives(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth, [S, C], "left_semi").withColumns({"label": F.lit(1), "pair_source": F.lit("ground_truth")})


def _wanted(ratio: int, most: int) -> Column:
    return F.when(F.coalesce("p", F.lit(0)) > 0, F.least(ratio * F.col("p"), F.lit(most))).otherwise(most)


def hard_negatives(pairs: DataFrame, truth: DataFrame, s1: DataFrame, rec: DataFrame, ratio: int = 5, most: int = 30) -> DataFrame:
    """The false candidates that agree on most keys: ``ratio`` for each positive of the S1 record and ``most`` at most."""
    wide = X.enrich(pairs.join(truth, [S, C], "left_anti"), s1, rec)
    return _hardest(wide.select(S, C, X.block_score().alias("block_score")).where("block_score > 0"), positives(pairs, truth), ratio, most)


def plan_negatives(plan: list[B.Rule], truth: DataFrame, s1: DataFrame, rec: DataFrame, ratio: int = 5, most: int = 30) -> DataFrame:
    """``hard_negatives`` of a plan's candidates, scored once for equal keys; only rows that can hold one of them are shuffled."""
    found = B.among(truth, s1, rec, plan)
    rows = X.enriched_kinds(s1, rec, plan).select(S, "__s", C, "__c", "__of", X.block_score().alias("block_score")).where("block_score > 0")
    true = X.enrich(found, s1, rec).groupBy(S).count().agg(F.max("count")).first()[0] or 0  # so many of an S1 record's best may be true
    true_ids = truth.groupBy(S).agg(F.collect_set(C).alias("__true"))
    rows = caps.kinds_within(rows, most + true, "block_score").select(F.explode("__s").alias(S), "__c", "block_score").join(true_ids, S, "left")
    false = F.filter("__c", lambda c: ~F.coalesce(F.array_contains("__true", c), F.lit(False)))
    return _hardest(rows.select(S, F.explode(false).alias(C), "block_score"), found, ratio, most)


def _hardest(scored: DataFrame, found: DataFrame, ratio: int, most: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(S).orderBy(F.desc("block_score"), C))
    first = scored.withColumn("rn", rank).where(F.col("rn") <= most)  # none gets more: rows over this leave before they are shuffled
    first = first.join(found.groupBy(S).agg(F.count("*").alias("p")), S, "left").where(F.col("rn") <= _wanted(ratio, most))
    return first.select(S, C, "block_score", "rn", F.lit(0).alias("label"), F.lit("hard_negative").alias("pair_source"))


def plan_pairs(plan: list[B.Rule], truth: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """``training_pairs`` of a plan's candidates."""
    keep = [S, C, "label", "pair_source"]
    return positives(B.among(truth, s1, rec, plan), truth).select(keep).unionByName(plan_negatives(plan, truth, s1, rec).select(keep))


def plan_balance(plan: list[B.Rule], truth: DataFrame, s1: DataFrame, rec: DataFrame, ratio: int = 5, most: int = 30) -> DataFrame:
    """(S, positives, negatives) that ``plan_pairs`` has of each S1 record, from counts: nothing is ranked."""
    true = B.among(truth, s1, rec, plan)
    rows = lambda wide, sign: wide.where(X.block_score() > 0).groupBy(S).agg((sign * F.count("*")).alias("n"))
    false = rows(X.enriched(s1, rec, plan), 1).unionByName(rows(X.enrich(true, s1, rec), -1)).groupBy(S).agg(F.sum("n").alias("n"))
    each = false.join(true.groupBy(S).agg(F.count("*").alias("p")), S, "full")
    each = each.select(S, F.coalesce("p", F.lit(0)).alias("positives"), F.least(F.coalesce("n", F.lit(0)), _wanted(ratio, most)).alias("negatives"))
    return each.where("positives + negatives > 0")


def training_pairs(pairs: DataFrame, truth: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    keep = [S, C, "label", "pair_source"]
    return positives(pairs, truth).select(keep).unionByName(hard_negatives(pairs, truth, s1, rec).select(keep))


def fold(entity: Column, seed: int = 42) -> Column:
    """0 to 99 by the entity's id and a seed: the one split that training and evaluation both use."""
    return F.conv(F.substring(F.md5(F.concat(entity, F.lit(f":{seed}")).cast("binary")), 1, 6), 16, 10).cast("long") % 100


def is_training(entity: Column, share: int = 80, seed: int = 42) -> Column:
    return fold(entity, seed) < share
