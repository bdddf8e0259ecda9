"""Pair features: exact flags, string and set similarities, lengths, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import similarity as sim
from spanloom.functions.keys import KEYS
from spanloom.plans import blocking as B

S, C = "source1_entity_id", "candidate_entity_id"
#: So many records of equal keys are one row at most.
SHARED = 64
#: String ratios of so many rows are a task's share of a hot key.
PART = 20_000
#: Flag name by key.
FLAGS = {
    "name_exact": "name_key",
    "name_sorted_exact": "sorted_name_key",
    "name_token_exact": "name_token_key",
    "first_name_exact": "first_name_token",
    "name_prefix_exact": "name_prefix_sig",
    "name_suffix_exact": "name_suffix_sig",
    "address_exact": "address_key",
    "address_number_exact": "address_number",
    "address_token_exact": "address_token_sig",
}


def enrich(pairs: DataFrame, s1: DataFrame, rec: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` with both sides' keys, as s_<key> and r_<key>."""
    columns = ("country", *KEYS, *extra)
    left = s1.select(F.col("entity_id").alias(S), *(F.col(k).alias(f"s_{k}") for k in columns))
    right = rec.select(F.col("entity_id").alias(C), F.col("source").alias("r_source"), *(F.col(k).alias(f"r_{k}") for k in columns))
    return pairs.join(left, S).join(right, C)


def enriched(s1: DataFrame, rec: DataFrame, plan: list[B.Rule], kept: tuple[str, ...] = ()) -> DataFrame:
    """``enrich`` of a plan's candidates: the keys come along with the join that makes the pairs, and the columns ``kept`` of S1."""
    split = B.by_repeats(s1, rec, plan)
    if split is None:
        return enrich(B.candidates(s1, rec, plan), s1, rec).join(s1.select(F.col("entity_id").alias(S), *kept).dropDuplicates([S]), S)
    columns = ("country", *KEYS)
    out = B.first_pairs(*split[:2], plan, (*(F.col(k).alias(f"s_{k}") for k in columns), *kept), (F.col("source").alias("r_source"), *(F.col(k).alias(f"r_{k}") for k in columns)))
    for a, b in split[2]:
        made = enrich(B.raw_candidates(a, b, plan).select(S, C).distinct(), a, b)
        out = out.unionByName(made.join(a.select(F.col("entity_id").alias(S), *kept).dropDuplicates([S]), S))
    return out


def enriched_kinds(s1: DataFrame, rec: DataFrame, plan: list[B.Rule], words: bool = False) -> DataFrame:
    """``enriched`` for many pairs at once: records with the same keys are one row's ``__s`` and ``__c``, and all of their pairs are meant.

    ``__of`` numbers the parts that were made apart; only within a part stands S for the same ids. With ``words`` the
    distinct words of names and addresses come along, as s_name_words and so on: they are taken once for each kind.
    """
    split = B.by_repeats(s1, rec, plan)
    sets = lambda *sides: {f"{x}{k}_words": F.array_distinct(_words(f"{x}{k}_key")) for x in sides for k in ("name", "address") if words}
    single = lambda df, of: df.withColumns({"__s": F.array(S), "__c": F.array(C), **sets("s_", "r_"), "__of": F.lit(of)})
    if split is None:
        return single(enrich(B.candidates(s1, rec, plan), s1, rec), 0)
    columns = ("country", *KEYS)
    mine, theirs = (B.kinds(df, by, SHARED).withColumns(sets("")) for df, by in ((split[0], columns), (split[1], ("source", *columns))))
    columns = (*columns, *sets(""))
    out = B.first_pairs(mine, theirs, plan, (*(F.col(k).alias(f"s_{k}") for k in columns), F.col("__ids").alias("__s")), (F.col("source").alias("r_source"), *(F.col(k).alias(f"r_{k}") for k in columns), F.col("__ids").alias("__c")), PART)
    out = out.withColumn("__of", F.lit(0))
    for i, (a, b) in enumerate(split[2], 1):
        out = out.unionByName(single(enrich(B.raw_candidates(a, b, plan).select(S, C).distinct(), a, b), i))
    return out


def each_pair(rows: DataFrame, *columns: str) -> DataFrame:
    """(S, C, columns) of all pairs that rows of ``enriched_kinds`` stand for."""
    return rows.select(F.explode("__s").alias(S), "__c", *columns).select(S, F.explode("__c").alias(C), *columns)


def same(key: str) -> Column:
    """Both sides have the key and it is equal."""
    return F.coalesce((F.col(f"s_{key}") != "") & (F.col(f"s_{key}") == F.col(f"r_{key}")), F.lit(False))


def flag(key: str) -> Column:
    return same(key).cast("int")


def exact_flags() -> dict[str, Column]:
    return {name: flag(key) for name, key in FLAGS.items()}


def block_score() -> Column:
    out = F.lit(0)
    for key in FLAGS.values():
        out = out + flag(key)
    return out


def _words(key: str, separator: str = " ") -> Column:
    return F.filter(F.split(F.col(key), separator, -1), lambda t: t != "")


def jaccards(compat: bool = True) -> dict[str, Column]:
    """Token-set Jaccards: as the compatible one-element sets, or over the real tokens."""
    if compat:
        return {"name_token_jaccard": flag("name_token_key").cast("double"), "address_token_jaccard": flag("address_token_sig").cast("double")}
    return {
        "name_token_jaccard_true": sim.jaccard(_words("s_name_token_key", r"\|"), _words("r_name_token_key", r"\|")),
        "address_token_jaccard_true": sim.jaccard(_words("s_address_key"), _words("r_address_key")),
    }


def lengths() -> dict[str, Column]:
    return {f"{k}_len_diff": F.abs(F.length(f"s_{k}_key") - F.length(f"r_{k}_key")).cast("int") for k in ("name", "address")}


def missing() -> dict[str, Column]:
    return {f"{who}_{k}_missing": (F.coalesce(F.col(f"{side}_{k}_key"), F.lit("")) == "").cast("int") for who, side in (("s1", "s"), ("candidate", "r")) for k in ("name", "address")}


def fuzz() -> dict[str, Column]:
    return {f"{k}_fuzz": sim.indel_ratio(F.col(f"s_{k}_key"), F.col(f"r_{k}_key")) for k in ("name", "address")}


FEATURES = [*FLAGS, "name_fuzz", "address_fuzz", "name_token_jaccard", "address_token_jaccard", "name_len_diff", "address_len_diff", "s1_name_missing", "candidate_name_missing", "s1_address_missing", "candidate_address_missing"]


def pair_features(pairs: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """The full feature table; further columns of ``pairs`` (label, pair_source) are kept."""
    kept = [c for c in pairs.columns if c not in (S, C)]
    return with_features(enrich(pairs, s1, rec), kept)


def with_features(wide: DataFrame, kept: list[str]) -> DataFrame:
    """``pair_features`` of rows with both sides' keys."""
    wide = wide.withColumns({**exact_flags(), **fuzz(), **jaccards(), **lengths(), **missing()})
    return wide.select(S, C, *kept, F.col("r_source").alias("source"), F.col("s_country").alias("country"), *FEATURES)


def heuristic_score(pairs: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """(S, C, score): the weighted score that needs no model."""
    return enrich(pairs, s1, rec).select(S, C, weighted().alias("score"))


def plan_heuristic(s1: DataFrame, rec: DataFrame, plan: list[B.Rule]) -> DataFrame:
    """(S, __s, C, __c, __of, score) of the rows of ``enriched_kinds``: ``heuristic_score`` of a plan's candidates, once for equal keys."""
    return enriched_kinds(s1, rec, plan, words=True).select(S, "__s", C, "__c", "__of", weighted(True).alias("score"))


def weighted(words: bool = False) -> Column:
    """The weighted score of rows with both sides' keys, and their words if these are there."""
    if words:
        name_j, address_j = (sim.jaccard_of_sets(F.col(f"s_{k}_words"), F.col(f"r_{k}_words")) for k in ("name", "address"))
    else:
        name_j, address_j = sim.jaccard(_words("s_name_key"), _words("r_name_key")), sim.jaccard(_words("s_address_key"), _words("r_address_key"))
    equal = lambda k: F.col(f"s_{k}") == F.col(f"r_{k}")
    on = lambda c: c.cast("double")
    score = (
        0.32 * sim.matcher_ratio(F.col("s_name_key"), F.col("r_name_key"))
        + 0.18 * name_j
        + 0.22 * sim.matcher_ratio(F.col("s_address_key"), F.col("r_address_key"))
        + 0.10 * address_j
        + 0.08 * on(same("address_number"))
        + 0.05 * on(equal("sorted_name_key"))
        + 0.05 * on(equal("name_key"))
        + 0.20 * on(equal("address_key"))
        + 0.20 * on(equal("name_key") & same("address_number"))
    )
    return F.least(score, F.lit(1.0))
