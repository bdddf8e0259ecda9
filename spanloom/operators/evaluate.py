"""Pair-, entity- and rule-level evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S, C = "source1_entity_id", "candidate_entity_id"


def share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f_half(p: Column, r: Column) -> Column:
    return F.when(0.25 * p + r == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def found_truth(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Every true pair with whether it is a candidate."""
    return truth.join(pairs.select(S, C).distinct().withColumn("hit", F.lit(1)), [S, C], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def missed(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(pairs, [S, C], "left_anti")


def recall_precision(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    t = found_truth(pairs, truth).agg(F.count("*").alias("true_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found_pairs"))
    return t.crossJoin(pairs.agg(F.count("*").alias("candidate_pairs"))).select(  # one row each
        "true_pairs", "found_pairs", "candidate_pairs", share(F.col("found_pairs"), F.col("true_pairs")).alias("recall"), share(F.col("found_pairs"), F.col("candidate_pairs")).alias("precision")
    )


def per_entity(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return found_truth(pairs, truth).groupBy(S).agg(F.count("*").alias("true_pairs"), F.sum("hit").alias("found_pairs"))


def candidate_counts(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """(S, candidates) for every S1 record, those without any included."""
    return counts_of(s1, pairs.groupBy(S).agg(F.count("*").alias("candidates")))


def counts_of(s1: DataFrame, numbers: DataFrame) -> DataFrame:
    """(S, candidates) for every S1 record, from the numbers of those that have any."""
    return s1.select(F.col("entity_id").alias(S)).join(numbers, S, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))


def rank_percentile(counts: DataFrame, column: str, p: float, kind: str) -> Column:
    """A percentile of few distinct values by a rank rule, from a sorted histogram's array: 'cumulative', 'index', 'floor'."""
    n = "aggregate(h, 0L, (a, x) -> a + x.n)"
    rank = {"cumulative": f"greatest(cast(floor({n} * {p}D) as bigint), 1L)", "index": f"cast(floor({p}D * ({n} - 1)) as bigint) + 1L", "floor": f"least(cast(floor({n} * {p}D) as bigint), {n} - 1L) + 1L"}[kind]
    return F.expr(f"aggregate(h, struct(0L as seen, cast(null as bigint) as v), (a, x) -> struct(a.seen + x.n as seen, case when a.v is null and a.seen + x.n >= {rank} then x.v else a.v end as v), a -> a.v)")


def count_percentiles(counts: DataFrame, column: str = "candidates", at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Interpolated percentiles and the three rank rules, maximum and share of zeros.

    The rank rules work on the histogram of the counts, never on the rows.
    """
    name = lambda p: f"p{round(100 * p)}"
    exact = counts.agg(*(F.percentile(column, F.lit(p)).alias(name(p)) for p in at), F.max(column).alias("max_count"), F.avg((F.col(column) == 0).cast("double")).alias("zero_rate"))
    h = counts.groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))
    return exact.crossJoin(h).select(*exact.columns, *(rank_percentile(h, column, p, k).alias(f"{name(p)}_{k}") for p in at for k in ("cumulative", "index", "floor")))


def graded(scored: DataFrame, truth: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(S, score, predicted, tp): numbers of each S1 record's pairs by score, a pair counted as often as it is true.

    ``hits`` are the scored pairs that are true, where they are known without looking for them in ``scored``.
    Rows of ``scored`` with a number ``pairs`` stand for so many.
    """
    number = F.sum("pairs") if "pairs" in scored.columns else F.count("*")
    times = truth.groupBy(S, C).agg(F.count("*").alias("m"))
    true = (scored if hits is None else hits).join(times, [S, C]).select(S, "score", (F.col("m") - 1).alias("predicted"), F.col("m").alias("tp"))
    every = scored.groupBy(S, "score").agg(number.alias("predicted")).withColumn("tp", F.lit(0).cast("long"))
    return every.unionByName(true).groupBy(S, "score").agg(F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))


def reached(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(S, score, pairs): how many pairs of each S1 record have a threshold as the highest that they reach, from scored rows of ``enriched_kinds``."""
    level = F.array_max(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score")))
    some = rows.select(S, "__of", "__s", F.size("__c").alias("n"), level.alias("score")).where("score is not null")
    return some.groupBy(S, "__of", "score").agg(F.first("__s").alias("__s"), F.sum("n").alias("pairs")).select(F.explode("__s").alias(S), "score", "pairs")


def entity_scores(s1: DataFrame, predicted: DataFrame, truth: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(S, tp, predicted, actual, precision, recall, f_half) for every S1 record; both empty counts as right."""
    base = s1.select(F.col("entity_id").alias(S))
    alike = lambda df: df if df is None else df.select(S, C, F.lit(1.0).alias("score"))
    p = graded(alike(predicted), truth, alike(hits)).drop("score")
    a = truth.groupBy(S).agg(F.count("*").alias("actual"))
    x = base.join(p, S, "left").join(a, S, "left").fillna(0, ["predicted", "tp", "actual"])
    both = (F.col("predicted") == 0) & (F.col("actual") == 0)
    x = x.withColumn("precision", F.when(both, 1.0).otherwise(share(F.col("tp"), F.col("predicted")))).withColumn("recall", F.when(both, 1.0).otherwise(share(F.col("tp"), F.col("actual"))))
    return x.withColumn("f_half", F.when(both, 1.0).otherwise(f_half(F.col("precision"), F.col("recall"))))


def pair_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts, precision, recall and F0.5 of (label, score) at each threshold."""
    t = scored.select("label", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    on, yes = F.col("score") >= F.col("threshold"), F.col("label") == 1
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    x = t.groupBy("threshold").agg(count(on & yes, "tp"), count(on & ~yes, "fp"), count(~on & yes, "fn"), count(~on & ~yes, "tn"))
    x = x.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return x.withColumn("f_half", f_half(F.col("precision"), F.col("recall")))


def entity_sweep(s1: DataFrame, scored: DataFrame, truth: DataFrame, thresholds: list[float], hits: DataFrame | None = None) -> DataFrame:
    """Macro and micro metrics over every S1 record at each threshold, from one pass over the scored pairs."""
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    base = s1.select(F.col("entity_id").alias(S)).join(truth.groupBy(S).agg(F.count("*").alias("actual")), S, "left").select(S, F.coalesce("actual", F.lit(0)).alias("actual"), each)
    got = graded(scored, truth, hits).select("*", each).where("score >= threshold").groupBy("threshold", S).agg(F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    x = base.join(got, ["threshold", S], "left").fillna(0, ["predicted", "tp"])
    both = (F.col("predicted") == 0) & (F.col("actual") == 0)
    x = x.withColumns({"p": F.when(both, 1.0).otherwise(share(F.col("tp"), F.col("predicted"))), "r": F.when(both, 1.0).otherwise(share(F.col("tp"), F.col("actual")))})
    x = x.withColumn("f", F.when(both, 1.0).otherwise(f_half(F.col("p"), F.col("r"))))
    exact = (F.col("tp") == F.col("predicted")) & (F.col("tp") == F.col("actual"))
    y = x.groupBy("threshold").agg(
        # the order of summation must not show
        F.round(F.avg("p"), 9).alias("macro_precision"),
        F.round(F.avg("r"), 9).alias("macro_recall"),
        F.round(F.avg("f"), 9).alias("macro_f_half"),
        F.round(F.avg("predicted"), 9).alias("mean_predicted"),
        F.round(F.avg("actual"), 9).alias("mean_true"),
        F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"),
        F.sum("actual").alias("actual"),
        F.sum(exact.cast("long")).alias("exact_sets"),
        F.sum((F.col("predicted") == 0).cast("long")).alias("empty_predictions"),
        F.percentile("predicted", F.lit(0.5)).alias("median_predicted"),
        F.percentile("predicted", F.lit(0.9)).alias("p90_predicted"),
        F.max("predicted").alias("max_predicted"),
    )
    y = y.withColumns({"micro_precision": share(F.col("tp"), F.col("predicted")), "micro_recall": share(F.col("tp"), F.col("actual"))})
    return y.withColumn("micro_f_half", f_half(F.col("micro_precision"), F.col("micro_recall")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the best macro F0.5, then precision, then recall."""
    return sweep.orderBy(F.desc("macro_f_half"), F.desc("macro_precision"), F.desc("macro_recall"), "threshold").limit(1)
