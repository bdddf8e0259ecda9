"""Whole jobs over files and tables: build, block, match, evaluate."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import caps, evaluate, features, forensics, model, output
from spanloom.plans import blocking as B
from spanloom.sources.records import read_records, read_tsv, write_tsv
from spanloom.sources.store import in_batches

S, C = "source1_entity_id", "candidate_entity_id"


def build_records(spark: SparkSession, paths: dict[str, str], profile: str = "v2", limit: int | None = None) -> DataFrame:
    """The keyed records of all sources: ``paths`` maps a source's name to its file; ``limit`` takes so many rows of each."""
    out = None
    for source, path in paths.items():
        part = read_records(spark, path, source, profile, limit)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def evaluate_blocking(s1: DataFrame, rec: DataFrame, truth: DataFrame, rules: list[B.Rule] = B.TEN) -> dict[str, DataFrame]:
    """Reports on a plan: pairs (recall, precision), rules (gain of each), counts (percentiles), buckets (recall by matches), reduction."""
    pairs = B.candidates(s1, rec, rules)
    raw = B.raw_candidates(s1, rec, rules)
    names = F.element_at(F.array(*(F.lit(r.name) for r in rules)), F.col("rule_idx") + 1).alias("rule")
    by_entity = evaluate.per_entity(pairs, truth)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    sizes = n(pairs, "pairs").crossJoin(n(s1, "s1_records")).crossJoin(n(rec, "records"))  # one row each
    return {
        "pairs": evaluate.recall_precision(pairs, truth),
        "rules": B.first_rule(raw).groupBy("rule_idx").agg(F.count("*").alias("new_pairs")).select(names, "new_pairs"),
        "counts": evaluate.count_percentiles(evaluate.candidate_counts(s1, pairs)),
        "buckets": by_entity.groupBy("true_pairs").agg(F.count("*").alias("entities"), F.sum("found_pairs").alias("found_pairs")),
        "reduction": sizes.select("*", (1 - F.col("pairs") / (F.col("s1_records") * F.col("records"))).alias("reduction_ratio")),
    }


def blocking_volume(s1: DataFrame, rec: DataFrame, rules: list[B.Rule] = B.TEN) -> DataFrame:
    """(rule, volume): the pairs that each rule would propose, without making them."""
    names = F.element_at(F.array(*(F.lit(r.name) for r in rules)), F.col("rule_idx") + 1).alias("rule")
    return caps.volume(s1, rec, rules).select(names, "volume")


def diagnose_zero_candidates(s1: DataFrame, rec: DataFrame, rules: list[B.Rule] = B.EIGHT) -> DataFrame:
    """The counts of every rule for the S1 records that none gives a candidate."""
    return forensics.rule_counts(s1, rec, rules).where("total = 0")


def heuristic_match(s1: DataFrame, rec: DataFrame, matching: str | None = None, candidates: str | None = None, threshold: float = 0.72, max_matches: int = 11, rules: list[B.Rule] = B.TEN) -> DataFrame:
    """Match lists by the weighted score that needs no model; files are written where a path is given."""
    pairs = B.candidates(s1, rec, rules)
    picked = features.heuristic_score(pairs, s1, rec).where(F.col("score") >= threshold)
    lists = output.match_lists(s1, caps.per_entity_cap(picked, max_matches, [F.desc("score"), F.desc(C)]))
    return _written(s1, pairs, lists, matching, candidates)


def candidates_only_match(s1: DataFrame, rec: DataFrame, matching: str | None = None, candidates: str | None = None, rules: list[B.Rule] = B.TEN) -> DataFrame:
    """Match lists that hold every candidate."""
    pairs = B.candidates(s1, rec, rules)
    return _written(s1, pairs, output.match_lists(s1, pairs), matching, candidates)


def _written(s1: DataFrame, pairs: DataFrame, lists: DataFrame, matching: str | None, candidates: str | None) -> DataFrame:
    if candidates:
        write_tsv(pairs.orderBy(S, C), candidates)
    if matching:
        write_tsv(lists.orderBy(S), matching)
    return lists


def evaluate_candidates_file(spark: SparkSession, s1: DataFrame, truth: DataFrame, candidates: str) -> dict[str, DataFrame]:
    """Recall, precision and counts of a candidate file (long form, tab-separated)."""
    pairs = read_tsv(spark, candidates, output.PAIRS).distinct()
    return {"pairs": evaluate.recall_precision(pairs, truth), "counts": evaluate.count_percentiles(evaluate.candidate_counts(s1, pairs))}


def build_features(pairs: DataFrame, s1: DataFrame, rec: DataFrame, path: str, batches: int = 16) -> DataFrame:
    """The feature table below ``path``, in parts that a later run doesn't make again."""
    return in_batches(pairs, S, path, batches, lambda part: features.pair_features(part, s1, rec))


def save_artefacts(spark: SparkSession, fitted: PipelineModel, threshold: float, path: str, **about: object) -> None:
    """The model, and its threshold with whatever is known about it."""
    fitted.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"threshold": threshold, **about}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/threshold")


def load_artefacts(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """(model, {"threshold": ...}) as they were saved."""
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/threshold").first()[0])


def predict(spark: SparkSession, path: str, s1: DataFrame, rec: DataFrame, rules: list[B.Rule] = B.BASE) -> DataFrame:
    """Match lists by a saved model and its threshold."""
    fitted, known = load_artefacts(spark, path)
    scored = model.score(fitted, features.pair_features(B.candidates(s1, rec, rules), s1, rec))
    return output.match_lists(s1, scored.where(F.col("score") >= known["threshold"]))
