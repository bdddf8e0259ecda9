"""URL filtering with pattern rules that are indexed by their rarest token.

Rules come in two scopes.  A ``place`` rule names a host and a path prefix: it
fits the host and its subdomains, the longest fitting rule decides.  A
``pattern`` rule is a filter expression over the whole lower-cased URL: ``||``
anchors at a host label, ``|`` at an end, ``*`` is any text and ``^`` a
separator or the end; allow patterns outrank block patterns, and patterns
decide only where no place rule fits.

Tokens are runs of a-z and 0-9.  A rule's literal tokens are those that any URL
it fits must have as whole tokens; the rule is filed under the one that fewest
URLs have.  A URL's tokens fetch its candidate rules, and only those run their
regular expression.  A rule without such a token is filed under the empty
token, which every URL has.

Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules are broadcast (a rule takes well under 1 kB); more are joined by a shuffle.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    scope: str  # place or pattern
    text: str  # host and path prefix, or the filter expression
    regex: str
    tokens: tuple[str, ...]


def place_rule(action: str, text: str) -> Rule:
    """``text``: a host, and from the first slash on a path prefix."""
    host, slash, path = text.partition("/")
    bounded = text.lower() if not slash or not re.search(r"[A-Za-z0-9]$", text) else re.sub(r"[A-Za-z0-9]+$", "", text).lower()
    end = "" if slash else "(?:/|$)"
    return Rule(action, "place", text, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}{end}", tuple(re.findall(r"[a-z0-9]+", bounded)))


def pattern_rule(action: str, text: str) -> Rule:
    """A filter expression; it is matched against the URL with A-Z lower-cased."""
    body, regex = text.lower(), ""
    if body.startswith("||"):
        regex, body = r"^[^:]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        regex, body = "^", body[1:]
    closed = body.endswith("|")
    body = body.removesuffix("|")
    opened = bool(regex)
    for c in body:
        regex += ".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c)
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", body):
        before = opened if m.start() == 0 else body[m.start() - 1] != "*"
        after = closed if m.end() == len(body) else body[m.end()] != "*"
        if before and after:
            tokens.append(m[0])
    return Rule(action, "pattern", text, regex + ("$" if closed else ""), tuple(tokens))


#: The rules of the query's contract.
PLACE_RULES = [
    place_rule("block", "com/en/"),
    place_rule("allow", "example.com/en/7"),
    place_rule("allow", "net/de/"),
    place_rule("block", "example.net/de/8"),
    place_rule("block", "org/es/"),
]

#: Advertising, tracking, spam and adult hosts and paths.
PATTERN_RULES = [
    *(pattern_rule("block", f"||{host}^") for host in ("doubleclick.net", "googlesyndication.com", "adservice.google.com", "adnxs.com", "taboola.com", "outbrain.com")),
    *(pattern_rule("block", f"/{part}/") for part in ("adserver", "adverts", "banners", "popunder", "sponsored-links", "tracking-pixel")),
    *(pattern_rule("block", f"://*{word}^") for word in ("casino", "viagra", "porn", "xxx")),
    *(pattern_rule("block", f"-{word}.") for word in ("pills", "casino", "porn", "poker", "loans")),
    *(pattern_rule("block", f".{word}.") for word in ("casino", "poker", "viagra", "porn", "xxx", "adult", "spam")),
    *(pattern_rule("block", f"://{word}.") for word in ("casino", "poker", "viagra", "porn", "xxx", "adult", "spam", "ads", "adserver", "banner")),
    *(pattern_rule("block", f"://{word}-") for word in ("casino", "cheap-pills", "free-money", "porn", "adult", "xxx")),
    *(pattern_rule("block", f".{word}-") for word in ("casino", "cheap-pills", "free-money", "porn", "adult", "xxx")),
    pattern_rule("allow", "/help/adverts/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, rule_id, scope, action, rule, regex): each rule under its rarest literal token.

    ``urls`` has a column tokens.  How many URLs have a token is counted over
    all of them; of equally rare tokens the first by code point is taken.
    """
    spark = urls.sparkSession
    listed = spark.createDataFrame([(i, r.scope, r.action, r.text, r.regex, sorted(set(r.tokens)) or [""]) for i, r in enumerate(rules)], "rule_id int, scope string, action string, rule string, regex string, tokens array<string>")
    each = listed.withColumn("token", F.explode("tokens"))
    names = each.select("token").distinct()
    small = len(rules) <= BROADCAST_RULES
    seen = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(names) if small else names, "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = each.join(seen, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "scope", "action", "rule", "regex")).alias("r"))
    return rarest.select("r.token", "rule_id", "r.scope", "r.action", "r.rule", "r.regex")


def filter_urls(df: DataFrame, url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with host, path, rule and verdict for its URL column.

    rule is the longest fitting place rule or null; verdict is its action, else
    block where a block pattern fits and no allow pattern does, else allow.  A
    null URL and one without ``://`` have an empty host and path, fit no place
    rule, and the latter may still fit a pattern.  Equal URLs are judged once;
    repeated rows each appear.  An empty table gives no rows, and without rules
    everything is allowed.  Columns of ``df`` named like the four results are
    replaced, others are kept.
    """
    rules = PLACE_RULES + PATTERN_RULES if rules is None else rules
    keyed = df.drop("host", "path", "rule", "verdict").withColumn("__url", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    urls = keyed.select("__url").distinct()
    urls = urls.select("__url", F.translate("__url", _UPPER, _LOWER).alias("lower"), F.concat(host_of(F.col("__url")), path_of(F.col("__url"))).alias("place"), F.array_append(tokens_of(F.col("__url")), "").alias("tokens"))
    index = rule_index(urls, rules)
    asked = urls.select("__url", "lower", "place", F.explode("tokens").alias("token"))
    fits = asked.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token").where(F.expr("CASE WHEN scope = 'place' THEN place ELSE lower END rlike regex"))
    place = F.when(F.col("scope") == "place", F.struct(F.length("rule").alias("n"), "rule", "action"))
    judged = fits.groupBy("__url").agg(F.max(place).alias("best"), F.max(F.expr("scope = 'pattern' AND action = 'allow'")).alias("allowed"), F.max(F.expr("scope = 'pattern' AND action = 'block'")).alias("blocked"))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("blocked") & ~F.col("allowed"), "block"), F.lit("allow"))
    return (
        keyed.join(judged, "__url", "left")
        .withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url")), "rule": F.col("best.rule"), "verdict": verdict})
        .drop("__url", "best", "allowed", "blocked")
    )


def oracle_sql() -> str:
    """DuckDB: every rule against every URL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.scope)}, {quote(r.action)}, {quote(r.text)}, {quote(r.regex)})" for r in PLACE_RULES + PATTERN_RULES)
    lower = f"translate(x.u, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH rules(scope, action, rule, regex) AS (VALUES {values}),
rest AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
x AS (SELECT page_id, u, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rest),
fits AS (SELECT x.n, scope, action, rule FROM x, rules WHERE regexp_matches(CASE WHEN scope = 'place' THEN x.host || x.path ELSE {lower} END, regex)),
best AS (SELECT n, arg_max(rule, length(rule)) FILTER (WHERE scope = 'place') AS rule, arg_max(action, length(rule)) FILTER (WHERE scope = 'place') AS action,
    count(*) FILTER (WHERE scope = 'pattern' AND action = 'allow') AS allowed, count(*) FILTER (WHERE scope = 'pattern' AND action = 'block') AS blocked FROM fits GROUP BY n)
SELECT x.page_id, x.host, x.path, best.rule AS rule,
    coalesce(best.action, CASE WHEN blocked > 0 AND allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN best USING (n)"""
