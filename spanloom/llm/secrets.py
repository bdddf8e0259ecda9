r"""Secret scans with multipart credential linking.

Strong parts are reported wherever they stand: an assignment to a password,
secret, token or key, an access key identifier, and a long hexadecimal run.
Weak parts say little alone: an identifier such as a client id or user name, a
bare high-entropy string, an endpoint.  They are reported only when the parts
that complete them stand in the same scope (a paragraph), within a reach of so
many code points if one is given: a string next to an identifier, an identifier next to a secret, an
endpoint next to both.

Everything is DataFrame functions.  A regular expression's places come from the
pieces that ``split`` leaves between its matches, so no position needs Python.
Parts are dealt by document once; the running sums that turn pieces into
places, the scopes, and the interval join (for each weak part the nearest
complementary part before and after it, by a sweep over the ordered places,
never pairs of parts) all work within that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
STRING = r"[A-Za-z0-9+/]{32,}"
IDENTIFIER = r"""((?i:client_?id|user_?name|login|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
ENDPOINT = r"""[a-z][a-z0-9+]*://[^\x00-\x20"'<>]+"""
BREAK = r"\n[\x20\x09\x0D]*\n"
#: In the order in which spans of one start are listed; the last divides scopes.
KINDS = ["assign", "access", "hex", "pair_secret", "pair_id", "pair_endpoint", "break"]
PATTERNS = [ASSIGN, ACCESS, HEX, STRING, IDENTIFIER, ENDPOINT, BREAK]


def _parts(kind: int) -> Column:
    """Array of (kind, at, gap, size, fit): matches in order, with the code points since the last one.

    fit is whether the match counts; those that don't still take up their place.
    """
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    if KINDS[kind] in ("assign", "pair_id"):
        valued = F.transform(F.regexp_extract_all("text", pattern, F.lit(2)), lambda x: F.length(x) >= (6 if KINDS[kind] == "assign" else 3))
    elif KINDS[kind] == "pair_secret":
        valued = F.transform(found, lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]"))
    else:
        valued = F.transform(found, lambda _: F.lit(True))
    gaps = F.transform(F.split("text", PATTERNS[kind], -1), lambda x: F.length(x))
    zipped = F.arrays_zip(found.alias("f"), valued.alias("v"))
    built = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.get(gaps, i).cast("long").alias("gap"), F.length(x["f"]).cast("long").alias("size"), x["v"].alias("fit")))
    nothing = F.array().cast("array<struct<kind:int,at:int,gap:bigint,size:bigint,fit:boolean>>")
    return F.when(F.col("text").rlike(PATTERNS[kind]), built).otherwise(nothing)


def has_parts(text: Column) -> Column:
    """Whether anything in the text could be reported."""
    out = F.lit(False)
    for p in PATTERNS[:-1]:
        out = out | F.coalesce(text, F.lit("")).rlike(p)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, spans.

    spans is an array of (start, kind, end, name) in order of start and kind,
    in code points, end exclusive; kinds under 3 are the strong ones.  text_key
    is a hash of the text, to join spans back by (doc_id, text_key).  Parts
    complete each other anywhere in a paragraph, or within ``reach``.  A null
    text counts as empty and has no spans; repeated rows each appear; an empty
    table gives no rows; columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marker = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("fit")))
    key = ["doc_id", "text_key"]
    parts = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.concat(marker, *(_parts(k) for k in range(len(KINDS))))).alias("p")).select(*key, "p.*")
    # a partial aggregate first: repeated rows shrink before they meet
    parts = parts.groupBy(*key, "kind", "at").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("fit").alias("fit"), F.count("*").alias("copies"))
    so_far = W.partitionBy(*key, "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size")).where("fit or kind = -1")
    order = W.partitionBy(*key).orderBy("start", "kind")
    before = order.rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("scope", F.sum((F.col("kind") == len(KINDS) - 1).cast("long")).over(before))
    parts = parts.withColumn("covered", F.max(F.when(F.col("kind").between(0, 2), F.col("end"))).over(before))
    inside = W.partitionBy(*key, "scope").orderBy("start", "kind")
    back, ahead = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(0, W.unboundedFollowing)
    own = F.coalesce(F.col("kind").between(3, 5) & (F.col("covered") >= F.col("end")), F.lit(False))  # part of a strong one
    identifier, secret = F.col("kind").isin(1, 4) & ~own, F.col("kind").isin(0, 2, 3) & ~own

    def near(is_part: Column) -> Column:
        if reach is None:
            return F.coalesce(F.max(is_part).over(W.partitionBy(*key, "scope")), F.lit(False))
        behind = F.max(F.when(is_part, F.col("end"))).over(back)
        beyond = F.min(F.when(is_part, F.col("start"))).over(ahead)
        return F.coalesce(F.col("start") - behind <= reach, F.lit(False)) | F.coalesce(beyond - F.col("end") <= reach, F.lit(False))

    parts = parts.withColumns({"by_id": near(identifier), "by_secret": near(secret), "own": own})
    told = F.col("kind").between(0, 2) | ~F.col("own") & (
        (F.col("kind") == 3) & F.col("by_id") | (F.col("kind") == 4) & F.col("by_secret") | (F.col("kind") == 5) & F.col("by_id") & F.col("by_secret")
    )
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    found = parts.groupBy(*key).agg(
        F.max(F.when(F.col("kind") == -1, F.col("copies"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(told, F.struct("start", "kind", "end", F.when(told, name).alias("name"))))).alias("spans"),
    )
    return found.select(*key, "spans", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``find_secrets``."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.filter("spans", lambda s: s["kind"] <= 2)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by ``[kind]``; rows without one keep their text as it is.

    Overlapping spans are replaced together, under the name of the first.  Only
    rows in which something could be found are joined with their spans, so the
    other texts are not shuffled.  A column n_chars is brought up to date.
    """
    could = has_parts(F.col(text_col).cast("string"))
    columns = docs.columns
    some = docs.where(could)
    spans = find_secrets(some, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    hashed = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = some.join(spans, some[id_col].eqNullSafe(F.col("__id")) & (hashed == F.col("__key")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)
    filled = F.aggregate(
        "__spans",
        start,
        lambda acc, s: F.struct(
            F.when(s["end"] <= acc["at"], acc["out"])
            .when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["name"], F.lit("]")))
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))),
    )
    changed = joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(filled))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(dict(docs.dtypes)["n_chars"])))
    return docs.where(~could).unionByName(changed.select(*columns))


def oracle_sql(reach: int | None = None) -> str:
    """DuckDB: the same places, and an interval join of parts by inequality."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    scans = []
    for k, p in enumerate(PATTERNS):
        fit = {0: f"regexp_extract_all(text, {quote(p)}, 2)", 4: f"regexp_extract_all(text, {quote(p)}, 2)"}.get(k, f"regexp_extract_all(text, {quote(p)})")
        test = {0: "length(v) >= 6", 3: "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')", 4: "length(v) >= 3"}.get(k, "true")
        scans.append(f"SELECT n, {k} AS kind, i, gap, size, {test} AS fit FROM (SELECT n, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, unnest(vs) AS v FROM (SELECT n, regexp_extract_all(text, {quote(p)}) AS m, string_split_regex(text, {quote(p)}) AS g, {fit} AS vs FROM d))")
    names = "[" + ", ".join(map(quote, KINDS)) + "]"
    near = lambda what: f"EXISTS (SELECT 1 FROM q o WHERE o.n = q.n AND o.scope = q.scope AND o.kind IN ({what}) AND NOT o.own)" if reach is None else f"EXISTS (SELECT 1 FROM q o WHERE o.n = q.n AND o.scope = q.scope AND o.kind IN ({what}) AND NOT o.own AND ((o.start, o.kind) <= (q.start, q.kind) AND q.start - o.stop <= {reach} OR (o.start, o.kind) >= (q.start, q.kind) AND o.start - q.stop <= {reach}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({' UNION ALL '.join(scans)}),
placed AS (SELECT n, kind, fit, sum(gap + size) OVER (PARTITION BY n, kind ORDER BY i) - size AS start, sum(gap + size) OVER (PARTITION BY n, kind ORDER BY i) AS stop FROM p),
scoped AS (SELECT n, kind, start, stop, sum((kind = 6)::INT) OVER w AS scope, coalesce(kind BETWEEN 3 AND 5 AND max(CASE WHEN kind <= 2 THEN stop END) OVER w >= stop, false) AS own
    FROM placed WHERE fit WINDOW w AS (PARTITION BY n ORDER BY start, kind ROWS UNBOUNDED PRECEDING)),
q AS (SELECT * FROM scoped WHERE kind <= 5),
told AS (SELECT n, kind, start::BIGINT AS start, stop::BIGINT AS stop, {names}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM q
    WHERE kind <= 2 OR NOT own AND (kind = 3 AND {near('1, 4')} OR kind = 4 AND {near('0, 2, 3')} OR kind = 5 AND {near('1, 4')} AND {near('0, 2, 3')})),
g AS (SELECT n, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
    string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind <= 2) AS base, string_agg(s, ',' ORDER BY start, kind) AS every FROM told GROUP BY n)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (n)"""
