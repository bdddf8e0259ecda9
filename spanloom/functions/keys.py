"""Blocking keys as Column builders, by profile (v2 is the canonical one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import normalise as N

KEYS = ["name_key", "sorted_name_key", "name_token_key", "first_name_token", "address_number", "address_key", "name_prefix_sig", "name_suffix_sig", "address_token_sig"]


def first_longest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]


def _first(words: Column) -> Column:
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def bucket(compact: Column) -> Column:
    return (F.floor(F.length(compact) / 5) * 5).cast("long")


def signature(name_key: Column, last: bool = False) -> Column:
    """First or last four characters of the name without spaces, and its length bucket."""
    compact = F.replace(name_key, F.lit(" "), F.lit(""))
    part = F.right(compact, F.lit(4)) if last else F.left(compact, F.lit(4))
    return F.when(compact == "", "").otherwise(F.concat_ws(":", part, bucket(compact).cast("string")))


def name_keys(name: Column, profile: str = "v2", unicode: bool = True) -> dict[str, Column]:
    """name_key, sorted_name_key, name_token_key, first_name_token."""
    if profile == "v1":
        words = N.replace_tokens(N.tokens(N.plain(name, unicode)), N.NAME_MAP_V1)
        telling = F.filter(N.without(words, N.LEGAL_V1 + N.GENERIC_V1), lambda t: F.length(t) >= 3)
        named = N.without(words, N.LEGAL_V1)
        return {
            "name_key": F.array_join(words, " "),
            "sorted_name_key": F.array_join(F.array_sort(words), " "),
            "name_token_key": F.coalesce(first_longest(telling), first_longest(named), _first(words)),
            "first_name_token": F.coalesce(F.get(named, F.lit(0)), _first(words)),
        }
    every = N.tokens(N.normalise(name, profile, unicode))
    words = N.without(every, N.LEGAL_V2)
    ordered = F.array_sort(words)
    if profile in ("fast", "ascii"):
        words = F.when(F.size(words) == 0, every).otherwise(words)
        ordered = F.array_sort(F.array_distinct(words))
    return {
        "name_key": F.array_join(words, " "),
        "sorted_name_key": F.array_join(ordered, " "),
        "name_token_key": F.array_join(F.array_sort(F.array_distinct(words)), "|"),
        "first_name_token": _first(words),
    }


def address_token(address: Column, profile: str = "v2", unicode: bool = True) -> Column:
    if profile == "fast":
        return F.coalesce(F.left(first_longest(N.without(N.tokens(N.normalise(address, "fast", unicode)), N.ADDRESS_STOP)), F.lit(5)), F.lit(""))
    if profile == "diagnose":
        words = N.without(N.tokens(N.normalise(address, "diagnose", unicode)), N.ADDRESS_STOP)
        return F.coalesce(F.left(first_longest(F.filter(words, lambda t: (F.length(t) >= 5) & ~t.rlike(r"(?U)^\d+[a-z]?$"))), F.lit(5)), F.lit(""))
    if profile == "base":
        return F.array_join(F.array_sort(F.array_distinct(N.tokens(N.normalise(address, "base", unicode)))), " ")
    words = N.without(N.replace_tokens(N.tokens(N.normalise(address, "v2", unicode)), N.ADDRESS_MAP_V2), N.ADDRESS_STOP)
    longest = F.array_min(F.transform(words, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))["t"]
    return F.coalesce(F.left(longest, F.lit(5)), F.lit(""))


def address_keys(address: Column, profile: str = "v2", unicode: bool = True) -> dict[str, Column]:
    if profile == "v1":
        text = N.plain(address, unicode)
        return {"address_number": F.regexp_extract(text, N.NUMBER, 0), "address_key": F.array_join(N.replace_tokens(N.tokens(text), N.ADDRESS_MAP_V1), " ")}
    text = N.normalise(address, profile, unicode)
    return {"address_number": F.regexp_extract(text, N.NUMBER, 0), "address_key": text}


def address_numbers(address: Column, unicode: bool = True) -> Column:
    return F.array_distinct(F.regexp_extract_all(N.normalise(address, "ascii", unicode), F.lit(N.NUMBER), F.lit(0)))


def add_keys(df: DataFrame, profile: str = "v2", unicode: bool = True) -> DataFrame:
    """``df`` (business_name, business_address) with the nine keys; blank input gives blank keys."""
    name, address = F.col("business_name"), F.col("business_address")
    out = df.withColumns({**name_keys(name, profile, unicode), **address_keys(address, profile, unicode)})
    if profile == "base":
        words = F.split("name_key", " ")
        sig = {"name_prefix_sig": F.array_join(F.slice(words, 1, 2), " "), "name_suffix_sig": F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")}
    else:
        sig = {"name_prefix_sig": signature(F.col("name_key")), "name_suffix_sig": signature(F.col("name_key"), last=True)}
    return out.withColumns({**sig, "address_token_sig": address_token(address, profile, unicode)})
