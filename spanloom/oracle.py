"""DuckDB SQL for the queries, written independently of the Spark plans.

Words are compared as whole tokens (RE2's word boundaries know ASCII only), and
joins are stated rule by rule.
"""

from __future__ import annotations

from spanloom.functions import normalise as N
from spanloom.functions.keys import KEYS
from spanloom.operators.features import FLAGS
from spanloom.operators.forensics import RECOVERY
from spanloom.plans import blocking as B
from spanloom.queries import CAPS, COMBINED, SAMPLE, THRESHOLDS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _map(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in table.items())}}}"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


def _plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[\\p{{P}}\\p{{S}}]', ' ', 'g')"


def _mapped(words: str, table: dict[str, str]) -> str:
    return f"list_transform({words}, lambda x: coalesce({_map(table)}[x], x))"


def _without(words: str, stop) -> str:
    return f"list_filter({words}, lambda x: NOT list_contains({_list(stop)}, x))"


def _join(words: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({words}, '{by}'), '')"


def _substrings(x: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _longest(words: str) -> str:
    """The first of the longest."""
    return f"list_reduce({words}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"


def _first_longest(words: str) -> str:
    return f"(CASE WHEN len({words}) = 0 THEN NULL ELSE {_longest(words)} END)"


def _wordy(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"


_NUMBER = "coalesce(list_filter({}, lambda x: regexp_full_match(x, '\\d+[a-z]?'))[1], '')"


def _sig(part: str) -> str:
    return f"CASE WHEN compact = '' THEN '' ELSE {part}(compact, 4) || ':' || ((length(compact) // 5) * 5) END"


ENTITIES = f"""
words AS (SELECT doc_id, upper(trim(lang)) AS country, {_tokens("lower(regexp_replace(coalesce(text, ''), '[\\p{P}\\p{S}]', ' ', 'g'))")} AS tk FROM documents),
base AS (SELECT doc_id, country, tk[1:4] AS nm, tk[5:12] AS ad, len(tk) % 97 AS num, doc_id // 2 AS h FROM words),
copies AS (
    SELECT *, 'S1' AS source, 0 AS m FROM base WHERE doc_id % 2 = 0
    UNION ALL SELECT *, 'S2', h % 6 FROM base WHERE doc_id % 3 <> 0
    UNION ALL SELECT *, 'S3', (h + 3) % 6 FROM base WHERE doc_id % 5 < 3),
entities AS (SELECT source || '-' || doc_id AS entity_id, source, doc_id, country,
    trim(CASE m WHEN 1 THEN {_join("list_reverse(nm)")} WHEN 2 THEN {_join("nm[2:4]")} WHEN 4 THEN {_join("list_append(nm, 'company')")} WHEN 5 THEN {_join("nm[1:2]")} ELSE {_join("nm")} END) AS business_name,
    CASE WHEN m = 3 THEN '' ELSE trim((num + CASE WHEN m = 4 THEN 1 ELSE 0 END) || ' ' || CASE WHEN m = 5 THEN {_join("list_reverse(ad)")} ELSE {_join("ad")} END) END AS business_address FROM copies)"""

_V2_NAME = _mapped(_tokens(_plain("business_name")), N.NAME_MAP_V2)
_V2_ADDRESS = _mapped(_tokens(_plain("business_address")), N.NAME_MAP_V2)
KEYED = f"""{ENTITIES},
k1 AS (SELECT *, {_without(_V2_NAME, N.LEGAL_V2)} AS nt, {_V2_ADDRESS} AS atk FROM entities),
k2 AS (SELECT *, {_join("nt", "")} AS compact, {_without(_mapped("atk", N.ADDRESS_MAP_V2), N.ADDRESS_STOP)} AS ai FROM k1),
keyed AS (SELECT entity_id, source, doc_id, country, business_name, business_address,
    {_join("nt")} AS name_key, {_join("list_sort(nt)")} AS sorted_name_key, {_join("list_sort(list_distinct(nt))", "|")} AS name_token_key, coalesce(nt[1], '') AS first_name_token,
    {_NUMBER.format("atk")} AS address_number, {_join("atk")} AS address_key, {_sig("left")} AS name_prefix_sig, {_sig("right")} AS name_suffix_sig,
    coalesce(left(list_sort(list_transform(ai, lambda x: lpad((1000000 - length(x))::VARCHAR, 7, '0') || x))[1][8:], 5), '') AS address_token_sig FROM k2),
s1 AS (SELECT * FROM keyed WHERE source = 'S1'), rec AS (SELECT * FROM keyed WHERE source <> 'S1'),
truth AS (SELECT a.entity_id AS s, b.entity_id AS c FROM s1 a JOIN rec b USING (doc_id))"""


def rule(r: B.Rule) -> str:
    """(s, c) of a rule."""
    on = " AND ".join(f"a.{k} = b.{k} AND a.{k} <> ''" for k in r.keys)
    fits = ""
    if r.cap:
        both = ", ".join(("country", *r.keys))
        fits = f" WHERE ({', '.join(f'b.{k}' for k in ('country', *r.keys))}) IN (SELECT ({both}) FROM rec GROUP BY {both} HAVING count(*) <= {r.cap})"
        fits = f" JOIN (SELECT {both} FROM rec GROUP BY {both} HAVING count(*) <= {r.cap}) f ON {' AND '.join(f'f.{k} = b.{k}' for k in ('country', *r.keys))}"
    return f"SELECT a.entity_id AS s, b.entity_id AS c FROM s1 a JOIN rec b ON a.country = b.country AND {on}{fits}"


def union(plan: list[B.Rule]) -> str:
    return " UNION ".join(map(rule, plan))


def raw(plan: list[B.Rule]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, '{r.name}' AS rule, s, c FROM ({rule(r)})" for i, r in enumerate(plan))


WITH = f"WITH {KEYED}, cand AS ({union(B.BASE)}), "
PAIR = "s AS source1_entity_id, c AS candidate_entity_id"
TEN = f"WITH {KEYED}, cand AS ({union(B.BASE)}), raw AS ({raw(B.TEN)}), rules(i, rule) AS (VALUES {', '.join(f"({i}, '{r.name}')" for i, r in enumerate(B.TEN))})"


def eq(k: str) -> str:
    return f"(a.{k} <> '' AND a.{k} = b.{k})"


def every(keys, op: str) -> str:
    return "(" + f" {op} ".join(map(eq, keys)) + ")"


def count(cond: str, name: str) -> str:
    return f"coalesce(sum(({cond})::INT), 0)::BIGINT AS {name}"


SCORE = "(" + " + ".join(f"{eq(k)}::INT" for k in FLAGS.values()) + ")"
WIDE = "JOIN s1 a ON a.entity_id = p.s JOIN rec b ON b.entity_id = p.c"
MISSED = f"{WITH} p AS (SELECT * FROM truth EXCEPT SELECT * FROM cand)"
SCORED = f"{WITH} scored AS (SELECT s, c, {SCORE} / 9 AS score FROM cand p {WIDE})"
FOUND = f"{WITH} found AS (SELECT t.s, count(*) AS n, count(cand.s) AS f FROM truth t LEFT JOIN cand USING (s, c) GROUP BY t.s)"
COUNTS = f"{WITH} counts AS (SELECT entity_id AS s, count(cand.c) AS n FROM s1 LEFT JOIN cand ON cand.s = entity_id GROUP BY entity_id)"


def lists(pairs: str, name: str, cap: int = 0) -> str:
    ids = f"list_sort(list(c)){f'[1:{cap}]' if cap else ''}"
    return f"SELECT entity_id AS source1_entity_id, coalesce(array_to_string(ids, ','), '') AS {name} FROM s1 LEFT JOIN (SELECT s, {ids} AS ids FROM ({pairs}) GROUP BY s) g ON g.s = entity_id"


def keys(columns: str, prefix: str = KEYED, table: str = "keyed") -> str:
    return f"WITH {prefix} SELECT entity_id, {columns} FROM {table}"


_V1 = f"""{ENTITIES}, v AS (SELECT entity_id, {_mapped(_tokens(_plain("business_name")), N.NAME_MAP_V1)} AS t, {_tokens(_plain("business_address"))} AS a FROM entities),
w AS (SELECT *, list_filter({_without("t", N.LEGAL_V1 + N.GENERIC_V1)}, lambda x: length(x) >= 3) AS telling, {_without("t", N.LEGAL_V1)} AS named FROM v)"""
_F = f"""{ENTITIES}, v AS (SELECT entity_id, {_tokens(_wordy(_substrings("lower(business_name)", N.NAME_SUBSTRINGS_FAST)))} AS e, {_without(_tokens(_wordy(_substrings("lower(business_address)", N.NAME_SUBSTRINGS_FAST))), N.ADDRESS_STOP)} AS a FROM entities),
w AS (SELECT *, CASE WHEN len({_without("e", N.LEGAL_V2)}) = 0 THEN e ELSE {_without("e", N.LEGAL_V2)} END AS t FROM v)"""
_D = f"""{ENTITIES}, w AS (SELECT entity_id, list_filter({_without(_tokens(_substrings(_plain("business_address"), N.NAME_SUBSTRINGS_DIAGNOSE)), N.ADDRESS_STOP)}, lambda x: length(x) >= 5 AND NOT regexp_full_match(x, '\\d+[a-z]?')) AS a FROM entities)"""

_ASCII = "list_filter(string_split(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _side(p: str) -> str:
    name, address = (_ASCII.format(_substrings(f"lower({p}.business_{x})", N.NAME_SUBSTRINGS_FAST)) for x in ("name", "address"))
    return f"{name} AS {p}n, {_without(name, N.LEGAL_V2)} AS {p}nt, {_without(address, N.ADDRESS_STOP)} AS {p}at, list_filter({address}, lambda x: regexp_full_match(x, '[0-9]+[a-z]?')) AS {p}num, {p}.business_address AS {p}a"


def _prefix(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"


def _rank(p: float, kind: str) -> str:
    at = {"cumulative": f"greatest(floor(count(*) * {p}::DOUBLE)::BIGINT, 1)", "index": f"floor({p}::DOUBLE * (count(*) - 1))::BIGINT + 1", "floor": f"least(floor(count(*) * {p}::DOUBLE)::BIGINT, count(*) - 1) + 1"}[kind]
    return f"list_sort(list(n))[{at}] AS p{round(100 * p)}_{kind}"


NEGATIVES = f"""{WITH} pos AS (SELECT s, count(*) AS n FROM (SELECT * FROM cand INTERSECT SELECT * FROM truth) GROUP BY s),
p AS (SELECT * FROM cand EXCEPT SELECT * FROM truth),
sc AS (SELECT s, c, {SCORE} AS block_score FROM p {WIDE}),
rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY block_score DESC, c) AS rn FROM sc WHERE block_score > 0),
neg AS (SELECT rk.* FROM rk LEFT JOIN pos USING (s) WHERE rn <= CASE WHEN coalesce(pos.n, 0) > 0 THEN least(5 * pos.n, 30) ELSE 30 END)"""
SPLIT = "('0x' || substring(md5(entity_id || ':42'), 1, 6))::BIGINT % 100"
_F05 = "CASE WHEN 0.25 * {p} + {r} = 0 THEN 0.0 ELSE 1.25 * {p} * {r} / (0.25 * {p} + {r}) END"
_T = f"t(threshold) AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in THRESHOLDS)}]))"
SWEEP = f"""{SCORED}, {_T},
act AS (SELECT entity_id AS s, count(truth.c) AS actual FROM s1 LEFT JOIN truth ON truth.s = entity_id GROUP BY entity_id),
got AS (SELECT threshold, scored.s, count(*) AS predicted, count(truth.s) AS tp FROM scored LEFT JOIN truth USING (s, c), t WHERE score >= threshold GROUP BY threshold, scored.s),
e AS (SELECT t.threshold, act.s, actual, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp FROM act CROSS JOIN t LEFT JOIN got ON got.s = act.s AND got.threshold = t.threshold),
e2 AS (SELECT *, CASE WHEN predicted = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS p, CASE WHEN predicted = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN actual = 0 THEN 0.0 ELSE tp / actual END AS r FROM e),
e3 AS (SELECT *, CASE WHEN predicted = 0 AND actual = 0 THEN 1.0 ELSE {_F05.format(p="p", r="r")} END AS f FROM e2),
m AS (SELECT threshold, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f), 9) AS macro_f_half, round(avg(predicted), 9) AS mean_predicted, round(avg(actual), 9) AS mean_true, sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(actual)::BIGINT AS actual,
    sum((tp = predicted AND tp = actual)::INT)::BIGINT AS exact_sets, sum((predicted = 0)::INT)::BIGINT AS empty_predictions, quantile_cont(predicted, 0.5)::DOUBLE AS median_predicted, quantile_cont(predicted, 0.9)::DOUBLE AS p90_predicted, max(predicted) AS max_predicted FROM e3 GROUP BY threshold),
m2 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS micro_precision, CASE WHEN actual = 0 THEN 0.0::DOUBLE ELSE tp / actual END AS micro_recall FROM m)"""


def _by_rule(value: str, grouped: str, name: str) -> str:
    return f"SELECT rules.rule, coalesce({value}, 0)::BIGINT AS {name} FROM rules LEFT JOIN ({grouped}) g USING (i)"


_FLAGS = {"name_exact": ["name_key"], "sorted_name": ["sorted_name_key"], "token_name": ["name_token_key"], "first_name": ["first_name_token"], "address_exact": ["address_key"], "address_number": ["address_number"], "address_token": ["address_token_sig"], "prefix": ["name_prefix_sig"], "suffix": ["name_suffix_sig"], "number_token": ["address_number", "address_token_sig"], "first_token": ["first_name_token", "address_token_sig"], "prefix_number": ["name_prefix_sig", "address_number"], "suffix_number": ["name_suffix_sig", "address_number"]}
_IN = "a.country = b.country"
_OLD = f"({_IN} AND ({eq('name_key')} OR {eq('sorted_name_key')} OR {eq('name_token_key')} AND {eq('address_number')}))"
_NEW = f"({_IN} AND ({every(_FLAGS['number_token'], 'AND')} OR {every(_FLAGS['first_token'], 'AND')}))"
_ANY_NAME = every(["name_key", "sorted_name_key", "name_token_key", "first_name_token", "name_prefix_sig", "name_suffix_sig"], "OR")
_ANY_ADDRESS = every(["address_key", "address_token_sig", "address_number"], "OR")
_NT = B.Rule(("address_number", "address_token_sig"))
_FINAL = B.final_rules(3, 10, 1)

_TEXTS = {
    "v1": _tokens(_plain("business_name")),
    "v2": _V2_NAME,
    "fast": _tokens(_wordy(_substrings("lower(business_name)", N.NAME_SUBSTRINGS_FAST))),
    "ascii": _ASCII.format(_substrings("lower(business_name)", N.NAME_SUBSTRINGS_FAST)),
    "analysis": _tokens(_wordy("lower(business_name)")),
    "base": _tokens("lower(business_name)"),
    "diagnose": _tokens(_substrings(_plain("business_name"), N.NAME_SUBSTRINGS_DIAGNOSE)),
}

_COLUMNS = ["entity_id", "source", "doc_id", "country", "business_name", "business_address", *KEYS]
_KINDS = [("records", i, c, "BIGINT" if c == "doc_id" else "STRING") for i, c in enumerate(_COLUMNS, 1)] + [("truth_pairs", 1, "source1_entity_id", "STRING"), ("truth_pairs", 2, "candidate_entity_id", "STRING")]
_EIGHT = f"WITH {KEYED}, raw AS ({raw(B.EIGHT)})"
_CAPPED = f"caps(cap) AS (SELECT unnest([{', '.join('NULL' if c is None else str(c) for c in CAPS)}]::BIGINT[]))"
_FREQ = lambda r: f"SELECT a.entity_id AS s, n FROM s1 a JOIN (SELECT country, {', '.join(r)}, count(*) AS n FROM rec GROUP BY ALL) f ON f.country = a.country AND {' AND '.join(f'f.{k} = a.{k} AND a.{k} <> {chr(39) * 2}' for k in r)}"
_LCS = """lcs(u, v, i, line) AS (SELECT u, v, 0, list_transform(range(length(v) + 1), lambda z: 0) FROM texts UNION ALL
    SELECT u, v, i + 1, list_reduce(list_transform(range(1, length(v) + 1), lambda j: [j]), lambda acc, q: list_append(acc, CASE WHEN substring(u, i + 1, 1) = substring(v, q[1]::INT, 1) THEN line[q[1]] + 1 ELSE greatest(line[q[1] + 1], acc[len(acc)]) END), [0]::BIGINT[]) FROM lcs WHERE i < length(u)),
ratios AS (SELECT u, v, 2 * line[len(line)] / (length(u) + length(v)) AS ratio FROM lcs WHERE i = length(u))"""
_FEATURES = f"""{', '.join(f"{eq(k)}::INT AS {n}" for n, k in FLAGS.items())}, coalesce(rn.ratio, 0.0::DOUBLE) AS name_fuzz, coalesce(ra.ratio, 0.0::DOUBLE) AS address_fuzz,
{eq("name_token_key")}::INT::DOUBLE AS name_token_jaccard, {eq("address_token_sig")}::INT::DOUBLE AS address_token_jaccard,
{', '.join(f"abs(length(a.{k}_key) - length(b.{k}_key))::INT AS {k}_len_diff" for k in ("name", "address"))},
{', '.join(f"({p}.{k}_key = '')::INT AS {who}_{k}_missing" for who, p in (("s1", "a"), ("candidate", "b")) for k in ("name", "address"))}"""

ORACLE_SQL: dict[str, str] = {
    "positive_pairs_read": f"WITH {KEYED}, n AS (SELECT s1.doc_id, count(truth.c) AS n FROM s1 LEFT JOIN truth ON truth.s = s1.entity_id GROUP BY s1.doc_id), x AS (SELECT n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT count(*) AS rows_read, {count('n = 0', 'rows_skipped')} FROM x WHERE before < {SAMPLE}",
    "catalog_columns": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {i}::BIGINT, '{c}', '{k}')" for a, i, c, k in _KINDS) + ") AS x(table_name, ordinal, column_name, data_type)",
    "country_display": f"WITH {ENTITIES} SELECT entity_id, CASE country WHEN 'FR' THEN 'France' WHEN 'EN' THEN 'US' ELSE country END AS shown FROM entities",
    "analysis_texts": f"WITH {ENTITIES}, x AS (SELECT entity_id, {_mapped(_tokens(_wordy('lower(business_name)')), N.NAME_MAP_ANALYSIS)} AS n, {_mapped(_tokens(_wordy('lower(business_address)')), N.ADDRESS_MAP_ANALYSIS)} AS a FROM entities) SELECT entity_id, {_join('n')} AS name, {_join('list_sort(n)')} AS sorted_name, {_join('a')} AS address FROM x",
    "match_count_summary": f"WITH {KEYED}, n AS (SELECT entity_id, count(truth.c) AS n FROM s1 LEFT JOIN truth ON truth.s = entity_id GROUP BY entity_id) SELECT count(*) AS s1_records, {count('n = 0', 'without_match')}, sum((n = 0)::INT)::BIGINT / count(*) AS no_match_share, max(n) AS most FROM n",
    "zero_candidate_counts": f"{_EIGHT} SELECT entity_id AS source1_entity_id, {', '.join(f'count(raw.s) FILTER (WHERE raw.i = {i}) AS r{i + 1}' for i in range(len(B.EIGHT)))}, count(raw.s) AS total FROM s1 LEFT JOIN raw ON raw.s = s1.entity_id GROUP BY entity_id",
    "two_frequency_recovery": f"{MISSED}, f1 AS ({_FREQ(('address_number', 'address_token_sig'))}), f2 AS ({_FREQ(('first_name_token', 'address_token_sig'))}), caps(cap) AS (SELECT unnest([{', '.join(str(c) for c in CAPS if c)}]::BIGINT[])), x AS (SELECT cap, coalesce(f1.n <= cap, false) AS a, coalesce(f2.n <= cap, false) AS b FROM p LEFT JOIN f1 USING (s) LEFT JOIN f2 USING (s) CROSS JOIN caps) SELECT cap, {count('a', 'one')}, {count('b', 'two')}, {count('a OR b', 'either')} FROM x GROUP BY cap",
    "cap_sweep_metrics": f"""{WITH} f AS (SELECT country, address_number, address_token_sig, count(*) AS n FROM rec GROUP BY ALL), {_CAPPED},
r AS (SELECT p.s, p.c, n FROM ({rule(_NT)}) p JOIN rec ON rec.entity_id = p.c JOIN f USING (country, address_number, address_token_sig)),
every_pair AS (SELECT cap, s, c, 0 AS fresh FROM cand CROSS JOIN caps UNION ALL SELECT cap, s, c, 1 FROM r CROSS JOIN caps WHERE (cap IS NULL OR n <= cap) AND (s, c) NOT IN (SELECT (s, c) FROM cand)),
e AS (SELECT caps.cap, entity_id, count(q.c) AS n, coalesce(sum(q.fresh), 0) AS fresh, count(truth.s) AS hits FROM s1 CROSS JOIN caps LEFT JOIN every_pair q ON q.s = entity_id AND q.cap IS NOT DISTINCT FROM caps.cap LEFT JOIN truth ON truth.s = q.s AND truth.c = q.c GROUP BY caps.cap, entity_id)
SELECT cap, sum(fresh)::BIGINT AS added, sum(n)::BIGINT AS total, sum(hits)::BIGINT AS found, sum(hits)::BIGINT / (SELECT count(*) FROM truth) AS recall, sum(hits)::BIGINT / sum(n)::BIGINT AS precision, sum(n)::BIGINT / count(*) AS mean_candidates, quantile_cont(n, 0.99)::DOUBLE AS p99 FROM e GROUP BY cap""",
    "pair_features": f"""{NEGATIVES.replace('WITH ', 'WITH RECURSIVE ', 1)},
labelled AS (SELECT s, c, 1 AS label, 'ground_truth' AS pair_source FROM (SELECT * FROM cand INTERSECT SELECT * FROM truth) UNION ALL SELECT s, c, 0, 'hard_negative' FROM neg),
texts AS (SELECT DISTINCT u, v FROM (SELECT a.name_key AS u, b.name_key AS v FROM labelled p {WIDE} UNION SELECT a.address_key, b.address_key FROM labelled p {WIDE}) WHERE u <> '' AND v <> ''),
{_LCS}
SELECT {PAIR}, label, pair_source, b.source AS source, a.country AS country, {_FEATURES} FROM labelled p {WIDE} LEFT JOIN ratios rn ON rn.u = a.name_key AND rn.v = b.name_key LEFT JOIN ratios ra ON ra.u = a.address_key AND ra.v = b.address_key""",
    "first_positive_pairs": f"WITH {KEYED}, x AS (SELECT s, c, row_number() OVER (ORDER BY doc_id, c) AS row_no FROM truth JOIN s1 ON entity_id = s) SELECT {PAIR}, row_no FROM x WHERE row_no <= {SAMPLE}",
    "normalise_profiles": f"WITH {ENTITIES} SELECT entity_id, {', '.join(f'{_join(x)} AS {n}' for n, x in _TEXTS.items())} FROM entities",
    "address_numbers": f"WITH {ENTITIES}, x AS (SELECT entity_id, list_sort(list_distinct(list_filter({_ASCII.format(_substrings('lower(business_address)', N.NAME_SUBSTRINGS_FAST))}, lambda x: regexp_full_match(x, '[0-9]+[a-z]?')))) AS n FROM entities) SELECT entity_id, {_join('n', ',')} AS numbers FROM x",
    "combination_recovery": f"{MISSED} SELECT {', '.join(count(every(ks, 'AND'), '_and_'.join(ks)) for ks in COMBINED)} FROM p {WIDE}",
    "s1_rule_counts": f"{TEN} SELECT s AS source1_entity_id, rule, count(*) AS candidates FROM raw GROUP BY s, rule",
    "jaccard_both_empty": f"WITH {KEYED}, p AS (SELECT * FROM truth), x AS (SELECT s, c, list_distinct(list_filter(string_split(a.address_key, ' '), lambda x: x <> '')) AS aa, list_distinct(list_filter(string_split(b.address_key, ' '), lambda x: x <> '')) AS ba FROM p {WIDE}) SELECT {PAIR}, round(CASE WHEN len(aa) = 0 AND len(ba) = 0 THEN 1.0::DOUBLE WHEN len(aa) = 0 OR len(ba) = 0 THEN 0.0 ELSE len(list_intersect(aa, ba)) / len(list_distinct(list_concat(aa, ba))) END, 6) AS jaccard FROM x",
    "score_statistics": f"{SCORED} SELECT min(score) AS least, max(score) AS most, round(avg(score), 9) AS mean FROM scored",
    "truth_explode": f"WITH {KEYED} SELECT s AS source1_entity_id, c AS matched_entity_id FROM truth",
    "truth_for_sample": f"WITH {KEYED} SELECT {PAIR} FROM truth WHERE s IN (SELECT entity_id FROM s1 ORDER BY doc_id LIMIT {SAMPLE})",
    "missing_records": f"WITH {KEYED} SELECT DISTINCT 'S2-' || doc_id AS entity_id FROM entities WHERE 'S2-' || doc_id NOT IN (SELECT entity_id FROM rec)",
    "table_counts": f"WITH {KEYED} SELECT 's1' AS table_name, count(*) AS rows FROM s1 UNION ALL SELECT 'records', count(*) FROM rec UNION ALL SELECT 'truth_pairs', count(*) FROM truth",
    "sample_first_n": f"WITH {KEYED} SELECT entity_id, business_name, business_address, country FROM s1 ORDER BY doc_id LIMIT {SAMPLE}",
    "name_keys_v1": f"WITH {_V1} SELECT entity_id, {_join('t')} AS name_key, {_join('list_sort(t)')} AS sorted_name_key, coalesce({_first_longest('telling')}, {_first_longest('named')}, t[1], '') AS name_token_key, coalesce(named[1], t[1], '') AS first_name_token FROM w",
    "name_keys_v2": keys("name_key, sorted_name_key, name_token_key, first_name_token"),
    "name_keys_fast": f"WITH {_F} SELECT entity_id, {_join('t')} AS name_key, {_join('list_sort(list_distinct(t))')} AS sorted_name_key, {_join('list_sort(list_distinct(t))', '|')} AS name_token_key, coalesce(t[1], '') AS first_name_token FROM w",
    "address_keys_v1": f"WITH {_V1} SELECT entity_id, {_join(_mapped('a', N.ADDRESS_MAP_V1))} AS address_key, {_NUMBER.format('a')} AS address_number FROM w",
    "address_token_sig_fast": f"WITH {_F} SELECT entity_id, coalesce(left({_first_longest('a')}, 5), '') AS address_token_sig FROM w",
    "address_token_sig_diagnose": f"WITH {_D} SELECT entity_id, coalesce(left({_first_longest('a')}, 5), '') AS address_token_sig FROM w",
    "name_signatures": keys("name_prefix_sig, name_suffix_sig"),
    "address_number": keys("address_number, address_key"),
    "address_token_sig": keys("address_token_sig"),
    "length_bucket_hist": f"WITH {KEYED} SELECT ((length(replace(name_key, ' ', '')) // 5) * 5)::BIGINT AS bucket, count(*) AS records FROM rec GROUP BY 1",
    "lcp_lcs_len": f"WITH {KEYED}, p AS (SELECT * FROM truth) SELECT {PAIR}, {_prefix('a.name_key', 'b.name_key')}::BIGINT AS prefix_length, {_prefix('reverse(a.name_key)', 'reverse(b.name_key)')}::BIGINT AS suffix_length FROM p {WIDE}",
    **{f"rule_{r.name}": f"WITH {KEYED} SELECT DISTINCT {PAIR} FROM ({rule(r)})" for r in B.EVERY_RULE},
    "or_blocking_union": f"WITH {KEYED} SELECT {PAIR} FROM ({union(B.TEN)})",
    "candidate_union": f"WITH {KEYED} SELECT {PAIR} FROM ({union(_FINAL)})",
    **{n: f"WITH {KEYED} SELECT DISTINCT {PAIR} FROM ({rule(_FINAL[i])})" for n, i in (("capped_addr_number_token", 3), ("capped_first_addr_token", 4), ("capped_prefix_number", 5))},
    "rule_incremental_gain": f"{TEN} {_by_rule('n', 'SELECT i, count(*) AS n FROM (SELECT s, c, min(i) AS i FROM raw GROUP BY s, c) GROUP BY i', 'new_pairs')}",
    "rule_standalone_gain": f"{TEN} {_by_rule('n', 'SELECT i, count(*) AS n FROM (SELECT DISTINCT i, s, c FROM raw) r WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.s = r.s AND cand.c = r.c) GROUP BY i', 'new_pairs')}",
    "rule_raw_volume": f"{TEN} {_by_rule('n', 'SELECT i, count(*) AS n FROM raw GROUP BY i', 'pairs')}",
    "rule_volume_estimate": f"{TEN} {_by_rule('n', 'SELECT i, count(*) AS n FROM raw GROUP BY i', 'volume')}",
    "rule_first_hits": f"{TEN} {_by_rule('n', 'SELECT i, count(*) AS n FROM (SELECT s, c, min(i) AS i FROM raw JOIN truth USING (s, c) GROUP BY s, c) GROUP BY i', 'hits')}",
    "rule_unique_hits": f"{TEN}, tr AS (SELECT i, s, c, count(*) OVER (PARTITION BY s, c) AS n FROM raw JOIN truth USING (s, c)) SELECT rules.rule, count(tr.s) AS hits, count(*) FILTER (WHERE tr.n = 1) AS unique_hits FROM rules LEFT JOIN tr USING (i) GROUP BY rules.rule",
    "key_frequency_distribution": f"WITH {KEYED}, f AS ({' UNION ALL '.join(f'SELECT {i} AS i, {chr(39)}{r.name}{chr(39)} AS rule, count(*) AS n FROM rec WHERE {' AND '.join(f"{k} <> ''" for k in r.keys)} GROUP BY country, {', '.join(r.keys)}' for i, r in enumerate(B.TEN))}) SELECT rule, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.99)::DOUBLE AS p99, max(n) AS max_frequency, count(*) AS keys FROM f GROUP BY rule",
    "cap_sweep": f"WITH {KEYED}, f AS (SELECT country, address_number, address_token_sig, count(*) AS n FROM rec GROUP BY ALL), r AS (SELECT s, c, n, EXISTS (SELECT 1 FROM truth t WHERE t.s = p.s AND t.c = p.c) AS hit FROM ({rule(_NT)}) p JOIN rec ON rec.entity_id = p.c JOIN f USING (country, address_number, address_token_sig)), caps(cap) AS (SELECT unnest([{', '.join('NULL' if c is None else str(c) for c in CAPS)}])) SELECT cap::BIGINT AS cap, count(*) AS pairs, sum(hit::INT)::BIGINT AS true_pairs, sum(hit::INT) / count(*) AS precision FROM r, caps WHERE cap IS NULL OR n <= cap GROUP BY cap",
    "freq_cap_recovery": f"{MISSED}, f AS (SELECT country, address_number, address_token_sig, count(*) AS n FROM rec GROUP BY ALL), q AS (SELECT n FROM p {WIDE} JOIN f ON f.country = a.country AND f.address_number = a.address_number AND f.address_token_sig = a.address_token_sig WHERE a.country = b.country AND {every(_NT.keys, 'AND')}) SELECT {', '.join(count(f'n <= {c}', f'within_{c}') for c in CAPS if c)}, count(*) AS agreeing FROM q",
    "per_s1_cap": f"{WITH} r AS (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY c) AS rn FROM cand) SELECT {PAIR}, rn FROM r WHERE rn <= 5",
    "hard_negatives": f"{NEGATIVES} SELECT {PAIR}, block_score::BIGINT AS block_score, rn FROM neg",
    "topk_matches": f"{WITH} sc AS (SELECT s, c, {SCORE} AS score FROM cand p {WIDE}), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, c DESC) AS rn FROM sc) SELECT {PAIR}, score::BIGINT AS score, rn FROM r WHERE rn <= 11",
    "matching_file": f"WITH {KEYED} {lists(f'SELECT DISTINCT s, c FROM ({rule(B.BASE[0])})', 'matched_entity_ids')}",
    "candidate_file_wide": f"{WITH} x AS (SELECT 1) {lists('SELECT s, c FROM cand', 'candidate_entity_ids')}",
    "candidate_file_long": f"{WITH} x AS (SELECT 1) SELECT {PAIR} FROM cand ORDER BY 1, 2",
    "matching_cap_slice": f"{WITH} x AS (SELECT 1) {lists('SELECT s, c FROM cand', 'matched_entity_ids', 5)}",
    "threshold_sweep_matches": f"{SCORED}, t(threshold) AS (SELECT unnest([0.3::DOUBLE, 0.6::DOUBLE, 0.9::DOUBLE])), g AS (SELECT threshold, s, string_agg(c, ',' ORDER BY c) AS ids FROM scored, t WHERE score >= threshold GROUP BY threshold, s) SELECT t.threshold, entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s1 CROSS JOIN t LEFT JOIN g ON g.s = entity_id AND g.threshold = t.threshold",
    "candidate_summary": f"{WITH} x AS (SELECT 1) SELECT count(*) AS pairs, count(DISTINCT s) AS s1_records, count(DISTINCT c) AS candidates FROM cand",
    "records_by_source_country": f"WITH {KEYED} SELECT source, country, count(*) AS records FROM rec GROUP BY source, country",
    "profile_missing": f"WITH {ENTITIES} SELECT source, count(*) AS records, {', '.join(count(f'trim({c}) = {chr(39) * 2}', f'blank_{c}') for c in ('entity_id', 'business_name', 'business_address', 'country'))} FROM entities GROUP BY source",
    "match_count_distribution": f"WITH {KEYED}, n AS (SELECT entity_id, count(truth.c) AS matches FROM s1 LEFT JOIN truth ON truth.s = entity_id GROUP BY entity_id) SELECT matches, count(*) AS s1_records FROM n GROUP BY matches",
    "pair_recall_precision": f"{FOUND}, x AS (SELECT sum(n)::BIGINT AS true_pairs, sum(f)::BIGINT AS found_pairs, (SELECT count(*) FROM cand) AS candidate_pairs FROM found) SELECT *, found_pairs / true_pairs AS recall, found_pairs / candidate_pairs AS precision FROM x",
    "reduction_ratio": f"{WITH} x AS (SELECT (SELECT count(*) FROM cand) AS pairs, (SELECT count(*) FROM s1) AS a, (SELECT count(*) FROM rec) AS b) SELECT pairs, 1 - pairs / (a * b) AS reduction_ratio FROM x",
    "fully_covered_entities": f"{FOUND} SELECT count(*) AS entities, {count('n = f', 'fully_covered')} FROM found",
    "recall_by_match_count": f"{FOUND} SELECT n AS matches, count(*) AS entities, sum(n)::BIGINT AS true_pairs, sum(f)::BIGINT AS found_pairs, sum(f) / sum(n) AS recall FROM found GROUP BY n",
    "candidate_count_percentiles": f"{COUNTS} SELECT {', '.join(f'quantile_cont(n, {p})::DOUBLE AS p{round(100 * p)}' for p in (0.5, 0.9, 0.95, 0.99))}, max(n) AS max_count, avg((n = 0)::INT) AS zero_rate, {', '.join(_rank(p, k) for p in (0.5, 0.9, 0.95, 0.99) for k in ('cumulative', 'index', 'floor'))} FROM counts",
    "zero_candidate_s1": f"{COUNTS} SELECT s AS source1_entity_id FROM counts WHERE n = 0",
    "nomatch_with_candidates": f"{WITH} x AS (SELECT s, count(*) AS n FROM cand WHERE s NOT IN (SELECT s FROM truth) GROUP BY s) SELECT count(*) AS s1_records, coalesce(sum(n), 0)::BIGINT AS pairs FROM x",
    "candidate_ceiling": f"{FOUND} SELECT sum(n)::BIGINT AS true_pairs, sum(f)::BIGINT AS found_pairs, round(avg(f / n), 9) AS mean_entity_recall, {count('n = f', 'fully_covered')}, count(*) AS entities, sum(f) / sum(n) AS pair_recall FROM found",
    "positive_pairs": f"{WITH} x AS (SELECT * FROM cand INTERSECT SELECT * FROM truth) SELECT {PAIR}, 'ground_truth' AS pair_source FROM x",
    "missed_true_pairs": f"{MISSED} SELECT {PAIR} FROM p",
    "missed_signal_overlap": f"{MISSED} SELECT count(*) AS missed, {', '.join(count(eq(k), k) for k in KEYS)} FROM p {WIDE}",
    "missed_any_signal": f"{MISSED} SELECT count(*) AS missed, {count(_ANY_NAME, 'any_name')}, {count(_ANY_ADDRESS, 'any_address')}, {count(f'NOT {_ANY_NAME} AND NOT {_ANY_ADDRESS}', 'no_signal')} FROM p {WIDE}",
    "missed_categories": f"{MISSED}, x AS (SELECT CASE WHEN {every(['name_key', 'sorted_name_key', 'name_token_key'], 'OR')} THEN 'strong_name_signal' WHEN {every(['address_key', 'address_token_sig'], 'OR')} THEN 'strong_address_signal' WHEN {eq('address_number')} AND {every(['name_prefix_sig', 'name_suffix_sig'], 'OR')} THEN 'number_name_signature' WHEN {eq('first_name_token')} THEN 'first_token_signal' ELSE 'weak_signal' END AS category FROM p {WIDE}) SELECT category, count(*) AS pairs FROM x GROUP BY category",
    "missed_categories_v7": f"{MISSED}, w AS (SELECT {_side('a')}, {_side('b')} FROM p {WIDE}), x AS (SELECT CASE WHEN aa = '' OR ba = '' THEN 'missing_address' WHEN len(an) = 0 OR len(bn) = 0 THEN 'missing_name' WHEN len(anum) > 0 AND len(bnum) > 0 AND NOT list_has_any(anum, bnum) THEN 'address_number_mismatch' WHEN list_has_any(ant, bnt) AND list_has_any(aat, bat) THEN 'partial_name_and_address_overlap' WHEN list_has_any(ant, bnt) THEN 'partial_name_overlap' WHEN list_has_any(aat, bat) THEN 'partial_address_overlap' ELSE 'heavy_name_address_noise' END AS category FROM w) SELECT category, count(*) AS pairs FROM x GROUP BY category",
    "signal_combinations": f"{MISSED}, x AS (SELECT coalesce(array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {eq(k)} THEN {chr(39)}{k}{chr(39)} END' for k in KEYS)}], lambda x: x IS NOT NULL)), ' + '), '') AS signals FROM p {WIDE}) SELECT signals, count(*) AS pairs FROM x GROUP BY signals",
    "rule_recovery": f"{MISSED} " + " UNION ALL ".join(f"SELECT '{'+'.join(ks)}' AS rule, {count(f'{_IN} AND {every(ks, "AND")}', 'recovered')} FROM p {WIDE}" for ks in RECOVERY),
    "rule_flags_union": f"{MISSED} SELECT {', '.join(count(f'{_IN} AND {every(ks, "AND")}', n) for n, ks in _FLAGS.items())}, {count(_OLD, 'union_existing')}, {count(_NEW, 'union_capped')}, {count(f'{_OLD} OR {_NEW}', 'union_all')} FROM p {WIDE}",
    "positive_signal_coverage": f"WITH {KEYED}, p AS (SELECT * FROM truth) SELECT b.source, count(*) AS pairs, {count(eq('name_key'), 'exact_name')}, {count(eq('sorted_name_key'), 'sorted_name')}, {count(eq('address_key'), 'exact_address')}, {count(every(['name_key', 'address_key'], 'AND'), 'both')}, {count(every(['name_key', 'address_key'], 'OR'), 'either')} FROM p {WIDE} GROUP BY b.source",
    "zero_candidate_diag": f"{TEN} SELECT entity_id AS source1_entity_id, country, (SELECT count(*) FROM rec WHERE rec.country = s1.country) AS country_records FROM s1 WHERE entity_id NOT IN (SELECT s FROM raw)",
    "features_exact": f"WITH {KEYED}, p AS (SELECT * FROM truth) SELECT {PAIR}, {', '.join(f'{eq(k)}::INT::BIGINT AS {n}' for n, k in FLAGS.items())} FROM p {WIDE}",
    "features_fuzz": f"""WITH RECURSIVE {KEYED}, p AS (SELECT * FROM truth), x AS (SELECT s, c, a.name_key AS u, b.name_key AS v FROM p {WIDE}),
lcs(s, c, i, line) AS (SELECT s, c, 0, list_transform(range(length(v) + 1), lambda z: 0) FROM x UNION ALL
    SELECT l.s, l.c, l.i + 1, list_reduce(list_transform(range(1, length(v) + 1), lambda j: [j]), lambda acc, q: list_append(acc, CASE WHEN substring(u, l.i + 1, 1) = substring(v, q[1]::INT, 1) THEN l.line[q[1]] + 1 ELSE greatest(l.line[q[1] + 1], acc[len(acc)]) END), [0]::BIGINT[])
    FROM lcs l JOIN x ON x.s = l.s AND x.c = l.c WHERE l.i < length(u))
SELECT x.s AS source1_entity_id, x.c AS candidate_entity_id, round(CASE WHEN u = '' OR v = '' THEN 0.0::DOUBLE ELSE 2 * line[len(line)] / (length(u) + length(v)) END, 6) AS name_fuzz FROM x JOIN lcs ON lcs.s = x.s AND lcs.c = x.c AND lcs.i = length(u)""",
    "features_jaccard": f"""WITH {KEYED}, p AS (SELECT * FROM truth), x AS (SELECT s, c, {eq("name_token_key")}::INT::DOUBLE AS name_token_jaccard, {eq("address_token_sig")}::INT::DOUBLE AS address_token_jaccard, list_filter(string_split(a.name_token_key, '|'), lambda x: x <> '') AS an, list_filter(string_split(b.name_token_key, '|'), lambda x: x <> '') AS bn, list_distinct(list_filter(string_split(a.address_key, ' '), lambda x: x <> '')) AS aa, list_distinct(list_filter(string_split(b.address_key, ' '), lambda x: x <> '')) AS ba FROM p {WIDE})
SELECT {PAIR}, name_token_jaccard, address_token_jaccard, round(CASE WHEN len(an) = 0 OR len(bn) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(an, bn)) / len(list_distinct(list_concat(an, bn))) END, 6) AS name_token_jaccard_true, round(CASE WHEN len(aa) = 0 OR len(ba) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(aa, ba)) / len(list_distinct(list_concat(aa, ba))) END, 6) AS address_token_jaccard_true FROM x""",
    "block_score": f"{WITH} x AS (SELECT s, c, {SCORE}::BIGINT AS block_score FROM cand p {WIDE}) SELECT {PAIR}, block_score FROM x",
    "entity_split": f"WITH {KEYED} SELECT entity_id, {SPLIT} AS fold, ({SPLIT} < 80)::INT::BIGINT AS is_training FROM s1",
    "class_balance": f"{NEGATIVES}, x AS (SELECT (SELECT sum(n) FROM pos)::BIGINT AS positives, (SELECT count(*) FROM neg) AS negatives) SELECT positives, negatives, negatives / positives AS weight FROM x",
    "pair_threshold_sweep": f"""{SCORED}, {_T}, l AS (SELECT threshold, score >= threshold AS o, EXISTS (SELECT 1 FROM truth WHERE truth.s = scored.s AND truth.c = scored.c) AS y FROM scored, t),
x AS (SELECT threshold, count(*) FILTER (WHERE o AND y) AS tp, count(*) FILTER (WHERE o AND NOT y) AS fp, count(*) FILTER (WHERE NOT o AND y) AS fn, count(*) FILTER (WHERE NOT o AND NOT y) AS tn FROM l GROUP BY threshold),
z AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM x) SELECT *, {_F05.format(p="precision", r="recall")} AS f_half FROM z""",
    "entity_f05": f"{SWEEP} SELECT s AS source1_entity_id, tp, predicted, actual, p AS precision, r AS recall, f AS f_half FROM e3 WHERE threshold = 0.6",
    "entity_threshold_sweep": f"{SWEEP} SELECT *, {_F05.format(p='micro_precision', r='micro_recall')} AS micro_f_half FROM m2",
    "best_threshold": f"{SWEEP} SELECT threshold, macro_f_half FROM m ORDER BY macro_f_half DESC, macro_precision DESC, macro_recall DESC, threshold LIMIT 1",
}
