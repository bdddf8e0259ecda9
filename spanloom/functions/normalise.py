"""Text normalisation profiles as Column builders.

Everything but NFKC is built in; NFKC goes through one Arrow function that gets
only the values that hold a character outside ASCII.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal forms, stop words and abbreviations that results depend on.
NAME_MAP_V1 = {
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
    "public": "pub",
    "societe": "soc",
    "etablissement": "etb",
    "प्राइवेट": "pvt",
    "लिमिटेड": "ltd",
    "कंपनी": "co",
    "प्रा": "pvt",
    "लि": "ltd",
}
NAME_MAP_V2 = {
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
    "public": "pub",
    "societe": "soc",
    "etablissement": "etb",
}
NAME_MAP_ANALYSIS = {
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
}
NAME_SUBSTRINGS_FAST = {
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
    "public": "pub",
    "societe anonyme": "sa",
    "societe": "soc",
    "etablissement": "etb",
}
NAME_SUBSTRINGS_DIAGNOSE = {
    "private limited": "pvt ltd",
    "public limited": "pub ltd",
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
    "public": "pub",
    "societe anonyme": "sa",
    "societe": "soc",
    "etablissement": "etb",
}
LEGAL_V1 = [
    "inc", "corp", "co", "ltd", "pvt", "llc", "llp", "limited", "company", "corporation", "incorporated", "private", "plc", "gmbh", "sarl",
    "sas", "sa", "soc", "etb",
]
GENERIC_V1 = [
    "services", "service", "solutions", "solution", "technologies", "technology", "enterprises", "enterprise", "consulting", "consultants",
    "management", "holdings", "holding", "group", "international", "global", "industries", "industry", "associates", "foundation",
    "ventures", "venture", "commercial", "commercials", "trading", "products", "systems",
]
LEGAL_V2 = [
    "corp", "co", "inc", "ltd", "pvt", "pub", "llc", "llp", "plc", "sa", "sarl", "gmbh", "ag", "limited", "company", "corporation",
]
ADDRESS_STOP = [
    "road", "rd", "street", "st", "lane", "ln", "avenue", "ave", "boulevard", "blvd", "highway", "hwy", "sector", "sec", "block",
    "district", "dist", "city", "town", "village", "near", "opposite", "opp", "india", "usa", "us", "france",
]
ADDRESS_MAP_V1 = {
    "road": "rd",
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "lane": "ln",
    "highway": "hwy",
    "apartment": "apt",
    "suite": "ste",
    "building": "bldg",
    "floor": "fl",
}
ADDRESS_MAP_V2 = {
    "road": "rd",
    "street": "st",
    "lane": "ln",
    "avenue": "ave",
    "boulevard": "blvd",
    "highway": "hwy",
    "apartment": "apt",
    "building": "bldg",
    "floor": "fl",
}
ADDRESS_MAP_ANALYSIS = {
    "road": "rd",
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "lane": "ln",
    "highway": "hwy",
    "apartment": "apt",
    "suite": "ste",
}
COUNTRY_DISPLAY = {
    "INDIA": "India",
    "US": "US",
    "FRANCE": "France",
}
# End of fixed values.

_MARKS = r"[\p{P}\p{S}&&[\x{0}-\x{FFFF}]]"
_NOT_WORD = r"[^\p{L}\p{N}_\s]"
NUMBER = r"(?U)\b\d+[a-z]?\b"


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in values.to_pylist()], pa.string())


def nfkc(x: Column) -> Column:
    """NFKC; null is empty. Only values with characters outside ASCII leave the JVM."""
    x = F.coalesce(x, F.lit(""))
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    """The words of a normalised text; an empty text has none."""
    return F.filter(F.split(collapse(x), " "), lambda t: t != "")


def replace_tokens(words: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def without(words: Column, stop: list[str]) -> Column:
    listed = F.array(*map(F.lit, stop))
    return F.filter(words, lambda t: ~F.array_contains(listed, t))


def _substrings(x: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def plain(x: Column, unicode: bool = True) -> Column:
    """Lower case, punctuation and symbols of the basic plane as spaces; white space as it is."""
    return F.regexp_replace(F.lower(nfkc(x) if unicode else F.coalesce(x, F.lit(""))), _MARKS, " ")


def normalise(x: Column, profile: str = "v2", unicode: bool = True) -> Column:
    """Text under a profile: v1, v2, fast, ascii, analysis, base or diagnose."""
    given = nfkc(x) if unicode else F.coalesce(x, F.lit(""))
    if profile == "v1":
        return plain(x, unicode)
    if profile == "v2":
        return F.array_join(replace_tokens(tokens(plain(x, unicode)), NAME_MAP_V2), " ")
    if profile == "fast":
        return collapse(F.regexp_replace(_substrings(F.lower(given), NAME_SUBSTRINGS_FAST), _NOT_WORD, " "))
    if profile == "ascii":
        return collapse(F.regexp_replace(_substrings(F.lower(given), NAME_SUBSTRINGS_FAST), "[^a-z0-9]+", " "))
    if profile == "analysis":
        return collapse(F.regexp_replace(F.lower(given), _NOT_WORD, " "))
    if profile == "base":
        return collapse(F.lower(given))
    if profile == "diagnose":
        return collapse(_substrings(plain(x, unicode), NAME_SUBSTRINGS_DIAGNOSE))
    raise ValueError(f"no profile named {profile!r}")


def analysis_name(x: Column) -> Column:
    """The name as the analysis of blocking signals has it."""
    return F.array_join(replace_tokens(tokens(normalise(x, "analysis")), NAME_MAP_ANALYSIS), " ")


def analysis_address(x: Column) -> Column:
    return F.array_join(replace_tokens(tokens(normalise(x, "analysis")), ADDRESS_MAP_ANALYSIS), " ")


def display_country(x: Column) -> Column:
    """A country's name as it is shown; unknown ones as they are, trimmed."""
    trimmed = F.trim(F.coalesce(x, F.lit("")))
    shown = F.create_map(*(F.lit(v) for kv in COUNTRY_DISPLAY.items() for v in kv))
    return F.coalesce(F.try_element_at(shown, F.upper(trimmed)), trimmed)


def country(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))
