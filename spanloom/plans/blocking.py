"""Blocking rules as one declarative plan.

A rule is an equi-join of S1 with the other records on country and some keys.
A plan of rules is not a join per rule and not one join with an OR: each side is
turned into (rule, key) rows and joined once, so there is one exchange per side
for any number of rules.  The pairs of a hot key are dealt to many tasks by their
number: its rows are few bytes, so adaptive execution wouldn't split them.  Blank
keys never match.

Where the records say which ids are repeated (``repeated``, as stored tables do),
the pairs of all others are distinct without being compared: a pair is made by
the first of its rules only.  Questions about known pairs or about numbers of
candidates are answered from keys, without making pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A key with more pairs than this is dealt to tasks in parts of about so many.
PART = 250_000
S, C = "source1_entity_id", "candidate_entity_id"


@dataclass(frozen=True)
class Rule:
    keys: tuple[str, ...]
    cap: int | None = None  # keys that more records than this have are left out

    @property
    def name(self) -> str:
        return "_and_".join(self.keys) + (f"_cap{self.cap}" if self.cap else "")


def rules(*keys: str) -> list[Rule]:
    return [Rule(tuple(k.split("+"))) for k in keys]


EVERY_RULE = rules(
    "name_key",
    "sorted_name_key",
    "name_token_key+address_number",
    "first_name_token+address_number",
    "first_name_token+address_number+name_prefix_sig",
    "first_name_token+address_number+name_suffix_sig",
    "address_key",
    "address_key+first_name_token",
    "name_prefix_sig",
    "name_suffix_sig",
    "address_token_sig",
    "name_prefix_sig+address_token_sig",
    "name_suffix_sig+address_token_sig",
    "first_name_token+address_token_sig",
    "name_token_key+address_token_sig",
    "sorted_name_key+address_token_sig",
    "name_prefix_sig+address_number+address_token_sig",
    "name_suffix_sig+address_number+address_token_sig",
    "first_name_token+address_number+address_token_sig",
    "name_token_key+address_number+address_token_sig",
    "address_number+address_token_sig",
    "name_prefix_sig+address_number",
    "name_suffix_sig+address_number",
)
BASE = rules("name_key", "sorted_name_key", "name_token_key+address_number")
TEN = rules(
    "name_key",
    "sorted_name_key",
    "name_token_key+address_number",
    "first_name_token+address_number",
    "first_name_token+address_number+name_prefix_sig",
    "first_name_token+address_number+name_suffix_sig",
    "address_key+first_name_token",
    "name_prefix_sig+address_token_sig",
    "name_suffix_sig+address_token_sig",
    "first_name_token+address_token_sig",
)

EIGHT = rules(
    "name_key",
    "sorted_name_key",
    "name_token_key+address_number",
    "first_name_token+address_number",
    "address_key",
    "name_prefix_sig",
    "name_suffix_sig",
    "address_token_sig",
)


def final_rules(number_token: int = 500, first_token: int = 500, prefix_number: int = 250) -> list[Rule]:
    """The base rules and three capped ones; caps are parameters, as they must fit the data."""
    return [
        *BASE,
        Rule(("address_number", "address_token_sig"), number_token),
        Rule(("first_name_token", "address_token_sig"), first_token),
        Rule(("name_prefix_sig", "address_number"), prefix_number),
    ]


def rule_key(rule: Rule):
    """A record's key for a rule, null unless all its columns are filled."""
    filled = F.lit(True)
    for k in rule.keys:
        filled = filled & F.coalesce(F.col(k) != "", F.lit(False))
    return F.when(filled, F.concat_ws("\x01", "country", *rule.keys))


def keyed(df: DataFrame, plan: list[Rule], id_name: str, *more) -> DataFrame:
    """(rule_idx, key, id) for every rule whose keys are all filled; ``more`` columns are carried along."""
    each = [F.struct(F.lit(i).alias("rule_idx"), rule_key(rule).alias("key")) for i, rule in enumerate(plan)]
    rows = df.select(F.col("entity_id").alias(id_name), *more, F.explode(F.filter(F.array(*each), lambda x: x["key"].isNotNull())).alias("x"))
    return rows.select("x.rule_idx", "x.key", *(c for c in rows.columns if c != "x"))


def key_frequency(rec: DataFrame, plan: list[Rule]) -> DataFrame:
    """(rule_idx, key, frequency) over the records."""
    return keyed(rec, plan, "candidate_entity_id").groupBy("rule_idx", "key").agg(F.count("*").alias("frequency"))


def capped(rec_keys: DataFrame, plan: list[Rule]) -> DataFrame:
    """Rows of keys that are within their rule's cap; rules without one are not counted."""
    limits = {i: r.cap for i, r in enumerate(plan) if r.cap}
    if not limits:
        return rec_keys
    limited = rec_keys.where(F.col("rule_idx").isin(*limits))
    cap = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))[F.col("rule_idx")]
    fits = limited.groupBy("rule_idx", "key").agg(F.count("*").alias("c")).where(F.col("c") <= cap).drop("c")
    return rec_keys.where(~F.col("rule_idx").isin(*limits)).unionByName(limited.join(fits, ["rule_idx", "key"], "left_semi"))


def matched(left: DataFrame, right: DataFrame, part: int | None = None) -> DataFrame:
    """The join of keyed rows on rule and key; keys with more than PART pairs are dealt to tasks in parts.

    With ``part``, for pairs that are dear, it is that many; and tasks that read little aren't put together, as their work isn't in what they read.
    """
    limit = part or PART
    n = lambda rows, name: rows.groupBy("rule_idx", "key").agg(F.count("*").alias(name))
    parts = F.least(F.ceil(F.col("a") * F.col("b") / limit), F.col("a")).cast("int").alias("parts")
    hot = n(left, "a").join(n(right, "b"), ["rule_idx", "key"]).where(F.col("a") * F.col("b") > limit).select("rule_idx", "key", parts)
    hot = F.broadcast(hot)  # a key of these has 1,000 rows or more; and a shuffle by key would keep its parts together
    of = F.coalesce("parts", F.lit(1))
    left = left.join(hot, ["rule_idx", "key"], "left").withColumn("part", F.pmod(F.xxhash64(S), of).cast("int")).drop("parts")
    right = right.join(hot, ["rule_idx", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), of - 1))).drop("parts")
    if part:
        spark = left.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        left, right = (df.repartition(tasks, "rule_idx", "key", "part") for df in (left, right))
    return left.join(right, ["rule_idx", "key", "part"]).drop("part")


def raw_candidates(s1: DataFrame, rec: DataFrame, plan: list[Rule]) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, rule_idx): a row for every rule that proposes the pair."""
    return matched(keyed(s1, plan, S), capped(keyed(rec, plan, C), plan)).select(S, C, "rule_idx")


def by_repeats(s1: DataFrame, rec: DataFrame, plan: list[Rule]) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]]] | None:
    """S1 and the records whose ids stand once, and the pairs of tables that hold all other pairs; None where that isn't known or a rule has a cap."""
    if any(r.cap for r in plan) or "repeated" not in s1.columns or "repeated" not in rec.columns:
        return None
    one = s1.where("not repeated")
    return one, rec.where("not repeated"), [(s1.where("repeated"), rec), (one, rec.where("repeated"))]


def kinds(df: DataFrame, columns: tuple[str, ...], most: int) -> DataFrame:
    """Records that agree on ``columns`` as one record: entity_id is the least of their ids, ``__ids`` has them all in order.

    Over ``most`` ids are dealt to several rows, so that no row stands for too many.
    """
    rows = df.groupBy(*columns).agg(F.array_sort(F.collect_list("entity_id")).alias("x"))
    starts = F.sequence(F.lit(1), F.size("x"), F.lit(most))
    rows = rows.select(*columns, F.explode(F.transform(starts, lambda i: F.slice("x", i, most))).alias("__ids"))
    return rows.select("*", F.col("__ids")[0].alias("entity_id"), F.lit(False).alias("repeated"))


def first_pairs(s1: DataFrame, rec: DataFrame, plan: list[Rule], mine: tuple = (), theirs: tuple = (), part: int | None = None) -> DataFrame:
    """Every pair of S1 and records that stand once, made by the first of its rules, with further columns of both sides."""
    keys = lambda name: F.array(*(rule_key(r) for r in plan)).alias(name)
    both = matched(keyed(s1, plan, S, keys("__mine"), *mine), keyed(rec, plan, C, keys("__theirs"), *theirs), part)
    again = F.lit(False)
    for i in range(len(plan) - 1):
        again = again | (F.col("rule_idx") > i) & F.coalesce(F.col("__mine")[i] == F.col("__theirs")[i], F.lit(False))
    return both.where(~again).drop("rule_idx", "key", "__mine", "__theirs")


def candidates(s1: DataFrame, rec: DataFrame, plan: list[Rule]) -> DataFrame:
    """Distinct pairs that any rule proposes."""
    split = by_repeats(s1, rec, plan)
    if split is None:
        return raw_candidates(s1, rec, plan).select(S, C).distinct()
    out = first_pairs(*split[:2], plan)
    for a, b in split[2]:
        out = out.unionByName(raw_candidates(a, b, plan).select(S, C).distinct())
    return out


def among(pairs: DataFrame, s1: DataFrame, rec: DataFrame, plan: list[Rule]) -> DataFrame:
    """The candidates that are among ``pairs``, from both sides' keys, without making others."""
    theirs = capped(keyed(rec, plan, C), plan)
    return pairs.select(S, C).distinct().join(keyed(s1, plan, S), S).join(theirs, [C, "rule_idx", "key"]).select(S, C).distinct()


def proposed(s1: DataFrame, rec: DataFrame, plan: list[Rule]) -> DataFrame:
    """(source1_entity_id) of the S1 records that have a candidate, without making pairs."""
    theirs = capped(keyed(rec, plan, C), plan).select("rule_idx", "key").distinct()
    return keyed(s1, plan, S).join(theirs, ["rule_idx", "key"], "left_semi").select(S).distinct()


def candidate_numbers(s1: DataFrame, rec: DataFrame, plan: list[Rule]) -> DataFrame:
    """(source1_entity_id, candidates) of the S1 records that have a candidate, from the frequencies of keys.

    Records that any of a few rules proposes are counted by inclusion and
    exclusion: those that agree on all keys of some rules, for each choice of
    rules.  Pairs with a repeated id are made and counted.
    """
    split = by_repeats(s1, rec, plan)
    if split is None:
        return candidates(s1, rec, plan).groupBy(S).agg(F.count("*").alias("candidates"))
    chosen = [c for n in range(1, len(plan) + 1) for c in combinations(plan, n)]
    every = [Rule(tuple(dict.fromkeys(k for r in c for k in r.keys))) for c in chosen]
    sign = F.element_at(F.array(*(F.lit(1 if len(c) % 2 else -1).cast("long") for c in chosen)), F.col("rule_idx") + 1)
    out = keyed(split[0], every, S).join(key_frequency(split[1], every), ["rule_idx", "key"]).select(S, (sign * F.col("frequency")).alias("n"))
    for a, b in split[2]:
        out = out.unionByName(raw_candidates(a, b, plan).select(S, C).distinct().select(S, F.lit(1).cast("long").alias("n")))
    return out.groupBy(S).agg(F.sum("n").alias("candidates"))


def first_rule(raw: DataFrame) -> DataFrame:
    """Each pair with the first rule that proposes it: one pass gives every rule's gain over those before it."""
    return raw.groupBy("source1_entity_id", "candidate_entity_id").agg(F.min("rule_idx").alias("rule_idx"), F.count_distinct("rule_idx").alias("rules"))
