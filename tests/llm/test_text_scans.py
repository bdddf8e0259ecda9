import hashlib
import random
import re

import pytest

from spanloom.llm import queries, secrets, url_filter

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain_base(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, fits) in enumerate(BASE) for m in p.finditer(text or "") if fits(m)]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def digest(docs):
    return {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}


def test_base_spans_equal_plain_expressions(spark, docs):
    rnd = random.Random(6)
    bits = ["password", "Passwd", "secret", "TOKEN", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "é", "日", "\n", "\n\n", "AKIA", "A" * 17, "0a" * 13, "f", "x", "=", "token=secret=", "secret=token:abcdefgh", "AKIAAKIA", "hunter22"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(250)] + [None, "", "password=" + "a" * 50_000, "api_key : 'x'"]
    got = digest(docs(*texts, extra=True))
    for i, t in enumerate(texts):
        base = plain_base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [base.count(f"{k}:") for k in ("assign", "access", "hex")]
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))


def test_weak_parts_need_complements(spark, docs):
    key, access, far = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "AKIA" + "Z7" * 8, " lorem" * 100
    texts = [
        f"id {access} key {key}",
        f"only {key} here",
        f"id {access}\n\nkey {key}",
        f"id {access}{far} key {key}",
        f"see https://db.example.com:5432/x with user_name=admin and {key}",
        "see https://db.example.com/x only",
        f"token={key}",
    ]
    got = digest(docs(*texts))
    kinds = [sorted(s.split(":")[0] for s in got[i]["spans"].split(",") if s) for i in range(len(texts))]
    assert kinds[0] == ["access", "pair_secret"]
    assert kinds[1] == [] and kinds[2] == ["access"] and kinds[3] == ["access", "pair_secret"]
    found = secrets.find_secrets(docs(texts[3], f"{access} key {key * 4}"), reach=256)
    near = {r["doc_id"]: r for r in secrets.digest(found).collect()}
    assert [near[i]["spans"].count("pair_secret") for i in (0, 1)] == [0, 1]  # a long string counts as well
    assert kinds[4] == ["pair_endpoint", "pair_id", "pair_secret"] and kinds[5] == []
    assert kinds[6] == ["assign"]


def test_repeated_rows_and_empty_table(spark, docs):
    d = docs("password=hunter22", "password=hunter22", "no", ids=[7, 7, 7])
    rows = secrets.digest(secrets.find_secrets(d)).collect()
    assert sorted(r["n_assign"] for r in rows) == [0, 1, 1]
    assert secrets.find_secrets(d.where("false")).count() == 0


def test_redaction(spark, docs):
    texts = ["a password=hunter22 b", None, "", "clean é text", "é token=abcdef12 x " + "0a" * 20]
    got = {r["doc_id"]: r for r in secrets.redact(docs(*texts, extra=True)).collect()}
    assert [got[i]["text"] for i in range(5)] == ["a [assign] b", None, "", "clean é text", "é [assign] x [hex]"]
    assert got[0]["n_chars"] == len("a [assign] b") and got[3]["text_key"] == "k"


@pytest.mark.parametrize("name", ["op3_multipart_secrets", "op9_token_indexed_urls"])
def test_query_matches_sql(same, name):
    assert same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_url_rules(spark):
    urls = {
        "http://example.com/en/7?x": ("example.com", "/en/7", "example.com/en/7", "allow"),
        "http://a.EXAMPLE.com/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/78": ("notexample.com", "/en/78", "com/en/", "block"),
        "http://x.example.net/de/81#t": ("x.example.net", "/de/81", "example.net/de/8", "block"),
        "http://example.net/de/1": ("example.net", "/de/1", "net/de/", "allow"),
        "http://org/es/": ("org", "/es/", "org/es/", "block"),
        "http://example.com/EN/1": ("example.com", "/EN/1", None, "allow"),
        "http://blog.cheap-pills.example.net/fr/1": ("blog.cheap-pills.example.net", "/fr/1", None, "block"),
        "https://ad.doubleclick.net/x": ("ad.doubleclick.net", "/x", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://": ("", "", None, "allow"),
        "a://b?c://d/en/": ("b", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df.unionByName(df)).collect()}
    assert got == urls
    assert url_filter.filter_urls(df.unionByName(df)).count() == 2 * len(urls)
    assert url_filter.filter_urls(df.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, rules=[]).collect()} == {"allow"}


def test_literal_tokens():
    assert url_filter.place_rule("block", "example.com/en/7").tokens == ("example", "com", "en")
    assert url_filter.pattern_rule("block", "||ads.net^").tokens == ("ads", "net")
    assert url_filter.pattern_rule("block", "/ban*ner/x").tokens == ()
    assert url_filter.pattern_rule("block", "://*casino^").tokens == ()
