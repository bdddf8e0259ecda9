"""Why true pairs are missed: signals, categories, rule recovery, zero-candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import keys as K
from spanloom.functions import normalise as N
from spanloom.functions.keys import KEYS
from spanloom.operators import features as X
from spanloom.plans import blocking as B

S, C = X.S, X.C
NAME_SIGNALS, ADDRESS_SIGNALS = ("name_key", "sorted_name_key", "name_token_key"), ("address_key", "address_token_sig")
#: Combinations of keys whose recovery of missed pairs is simulated.
RECOVERY = [(k,) for k in ("name_key", "sorted_name_key", "name_token_key", "first_name_token", "address_key", "address_number", "name_prefix_sig", "name_suffix_sig", "address_token_sig")] + [
    ("address_number", "address_token_sig"),
    ("first_name_token", "address_token_sig"),
    ("name_prefix_sig", "address_number"),
    ("name_suffix_sig", "address_number"),
    ("first_name_token", "address_number"),
]


def any_of(*keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | X.same(k)
    return out


def all_of(*keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & X.same(k)
    return out


def count_if(c: Column, name: str) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)


def signal_overlap(wide: DataFrame) -> DataFrame:
    return wide.agg(F.count("*").alias("missed"), *(count_if(X.same(k), k) for k in KEYS))


def any_signal(wide: DataFrame) -> DataFrame:
    name = any_of(*NAME_SIGNALS, "first_name_token", "name_prefix_sig", "name_suffix_sig")
    address = any_of(*ADDRESS_SIGNALS, "address_number")
    return wide.agg(F.count("*").alias("missed"), count_if(name, "any_name"), count_if(address, "any_address"), count_if(~name & ~address, "no_signal"))


def category() -> Column:
    """The strongest kind of agreement of a missed pair."""
    return (
        F.when(any_of(*NAME_SIGNALS), "strong_name_signal")
        .when(any_of(*ADDRESS_SIGNALS), "strong_address_signal")
        .when(X.same("address_number") & any_of("name_prefix_sig", "name_suffix_sig"), "number_name_signature")
        .when(X.same("first_name_token"), "first_token_signal")
        .otherwise("weak_signal")
    )


def noise_category(unicode: bool = True) -> Column:
    """What a missed pair still shares, by word and number sets of the texts (s_/r_ business_name and business_address)."""
    side = {}
    for p in ("s", "r"):
        name, address = F.col(f"{p}_business_name"), F.col(f"{p}_business_address")
        side[p] = (
            N.normalise(name, "ascii", unicode),
            N.without(N.tokens(N.normalise(name, "ascii", unicode)), N.LEGAL_V2),
            N.without(N.tokens(N.normalise(address, "ascii", unicode)), N.ADDRESS_STOP),
            K.address_numbers(address, unicode),
            F.coalesce(address, F.lit("")),
        )
    (sn, snt, sat, snum, sa), (rn, rnt, rat, rnum, ra) = side["s"], side["r"]
    overlap = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return (
        F.when((sa == "") | (ra == ""), "missing_address")
        .when((sn == "") | (rn == ""), "missing_name")
        .when((F.size(snum) > 0) & (F.size(rnum) > 0) & ~overlap(snum, rnum), "address_number_mismatch")
        .when(overlap(snt, rnt) & overlap(sat, rat), "partial_name_and_address_overlap")
        .when(overlap(snt, rnt), "partial_name_overlap")
        .when(overlap(sat, rat), "partial_address_overlap")
        .otherwise("heavy_name_address_noise")
    )


def combination() -> Column:
    """The names of all signals that agree, sorted and joined."""
    return F.array_join(F.array_sort(F.filter(F.array(*(F.when(X.same(k), F.lit(k)) for k in KEYS)), lambda x: x.isNotNull())), " + ")


def recovery(wide: DataFrame) -> DataFrame:
    """(rule, recovered): missed pairs that each combination would propose, countries agreeing."""
    inside = F.col("s_country") == F.col("r_country")
    flags = F.array(*(F.struct(F.lit("+".join(ks)).alias("rule"), (inside & all_of(*ks)).alias("on")) for ks in RECOVERY))
    return wide.select(F.explode(flags).alias("x")).groupBy("x.rule").agg(F.sum(F.col("x.on").cast("long")).alias("recovered"))


def rule_flags() -> dict[str, Column]:
    inside = F.col("s_country") == F.col("r_country")
    one = {"name_exact": "name_key", "sorted_name": "sorted_name_key", "token_name": "name_token_key", "first_name": "first_name_token", "address_exact": "address_key", "address_number": "address_number", "address_token": "address_token_sig", "prefix": "name_prefix_sig", "suffix": "name_suffix_sig"}
    two = {"number_token": ("address_number", "address_token_sig"), "first_token": ("first_name_token", "address_token_sig"), "prefix_number": ("name_prefix_sig", "address_number"), "suffix_number": ("name_suffix_sig", "address_number")}
    return {**{n: (inside & X.same(k)) for n, k in one.items()}, **{n: (inside & all_of(*ks)) for n, ks in two.items()}}


def rule_counts(s1: DataFrame, rec: DataFrame, plan: list[B.Rule]) -> DataFrame:
    """(S, r1 ..., total): how many records each rule gives every S1 record."""
    got = B.keyed(s1, plan, S).join(B.key_frequency(rec, plan), ["rule_idx", "key"])
    each = [F.sum(F.when(F.col("rule_idx") == i, F.col("frequency"))).alias(f"r{i + 1}") for i in range(len(plan))]
    out = s1.select(F.col("entity_id").alias(S)).join(got.groupBy(S).agg(*each, F.sum("frequency").alias("total")), S, "left")
    return out.fillna(0)


def two_frequency_recovery(missed: DataFrame, s1: DataFrame, rec: DataFrame, one: B.Rule, two: B.Rule, caps: list[int]) -> DataFrame:
    """(cap, one, two, either): missed pairs whose S1 keys have a frequency of at most the cap, by each of two rules and by any."""
    out = missed
    for name, r in (("f1", one), ("f2", two)):
        freq = B.keyed(s1, [r], S).join(B.key_frequency(rec, [r]), ["rule_idx", "key"]).select(S, F.col("frequency").alias(name))
        out = out.join(freq, S, "left")
    fits = lambda name: F.coalesce(F.col(name) <= F.col("cap"), F.lit(False))
    x = out.withColumn("cap", F.explode(F.array(*(F.lit(c).cast("long") for c in caps))))
    return x.groupBy("cap").agg(count_if(fits("f1"), "one"), count_if(fits("f2"), "two"), count_if(fits("f1") | fits("f2"), "either"))


def zero_candidates(s1: DataFrame, rec: DataFrame, plan: list[B.Rule]) -> DataFrame:
    """S1 records that no rule gives a candidate, with whether their country has records at all."""
    has = B.keyed(s1, plan, S).join(B.keyed(rec, plan, C).select("rule_idx", "key").distinct(), ["rule_idx", "key"], "left_semi").select(S).distinct()
    countries = rec.groupBy("country").agg(F.count("*").alias("country_records"))
    return s1.select(F.col("entity_id").alias(S), "country", "name_key", "address_key").join(has, S, "left_anti").join(countries, "country", "left").fillna(0, ["country_records"])
