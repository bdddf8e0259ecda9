import random
import re

import numpy as np
import pyarrow as pa

from spanloom.llm import queries
from spanloom.llm.common import utf8
from spanloom.llm.components import components
from spanloom.llm.near_dedup import HASHES, keep_one, near_duplicates, oracle_sql, shared_counts, signatures
from spanloom.llm.shingles import shingle_hashes, sorted_sets, word_hashes


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (size, least doc_id reachable)."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    lead = {k: k for k in range(len(sets))}

    def find(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)), key=lambda k: sets[k][0])
                lead[q] = p
    return sorted((i, len(s), sets[find(k)][0]) for k, (i, s) in enumerate(sets))


def variants(rnd, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_words_and_shingles_equal_their_definition():
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("aB é \t\n\x0b日 ", k=rnd.randint(0, 60))) for _ in range(300)] + ["", "one", "a b c d e", "a b c d e a b c d e"]
    data, offsets = utf8(pa.array(texts))
    words, at = word_hashes(data, offsets)
    values, at = sorted_sets(*shingle_hashes(words, at))
    got = [frozenset(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    plain = [shingle_set(t) for t in texts]
    assert [len(g) for g in got] == [len(p) for p in plain]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(plain[i] & plain[j])


def test_blocks_do_not_change_hashes(monkeypatch):
    import spanloom.llm.shingles as module

    texts = ["alpha beta " * 40, "", "x" * 500, "gamma delta"]
    data, offsets = utf8(pa.array(texts))
    whole = word_hashes(data, offsets)
    monkeypatch.setattr(module, "BLOCK_BYTES", 16)
    parts = word_hashes(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_signature_distance_follows_similarity():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3500], rnd.integers(0, 1 << 63, 500, dtype=np.uint64)])
    both = signatures(np.concatenate([a, b]), np.array([0, 4000, 8000]))
    assert abs((both[0] == both[1]).mean() - 3500 / 4500) < 4 * (0.17 / HASHES) ** 0.5


def test_shared_counts():
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 40).astype(np.uint64)) for i in range(9)]
    got = shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    lead = {}
    for u, v in edges:
        lead.setdefault(u, u), lead.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(lead[u], lead[v])
            changed |= lead[u] != low or lead[v] != low
            lead[u] = lead[v] = low
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in lead.items() if k in got} and set(got) >= {k for k, v in lead.items() if k != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_classes_equal_brute_force(spark, docs):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7)))
    texts = [None, "", " \n\t", "One", "one", "a b c", "A  b\nc", "a b c d", "x " * 3000]
    texts += variants(rnd, [word() for _ in range(120)], 60, 9) + variants(rnd, [word() for _ in range(40)], 30, 4)
    texts += [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += rnd.choices(texts, k=40)
    rnd.shuffle(texts)
    ids = rnd.sample(range(10_000), len(texts))
    got = near_duplicates(docs(*texts, ids=ids, extra=True)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(list(zip(ids, texts, strict=True)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_clashing_and_null_ids(docs):
    rnd = random.Random(6)
    base = [f"t{i}" for i in range(60)]
    other = " ".join(f"u{i}" for i in range(60))
    near = " ".join([*base[:30], "changed", *base[31:]])
    d = docs(" ".join(base), near, other, near, other + " x", ids=[3, 7, 7, None, None], extra=True)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(d).collect()), key=str)
    assert got == [(3, 3, True), (7, 3, False), (7, 7, True), (None, 3, False), (None, 7, False)]
    # documents that are joined through a row without an id only
    far = [*base[:14], "v", *base[15:44], "w", *base[45:]]
    middle = [*base[:14], "v", *base[15:]]
    chain = docs(" ".join([*base[:30], "z", *base[31:]]), " ".join(far), " ".join(base), " ".join(middle), ids=[5, 6, None, None])
    rows = [(1000 + i if i is None else i, t) for i, t in ((5, " ".join([*base[:30], "z", *base[31:]])), (6, " ".join(far)), (8, " ".join(base)), (9, " ".join(middle)))]
    assert {c for _, _, c in brute(rows)} == {5}
    assert {r["component_id"] for r in near_duplicates(chain).collect()} == {5}
    assert {(r["component_id"], r["kept"]) for r in near_duplicates(docs(near, near, ids=[None, None])).collect()} == {(None, False)}


def test_one_row_of_each_class_stays(docs):
    base = " ".join(f"t{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    d = docs(base, base, base.upper(), base + " x", other, other, None, "", "", "alone", ids=[4, 4, 2, None, None, None, 1, 1, None, 4], extra=True)
    kept = keep_one(d)
    assert kept.schema == d.schema
    got = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in kept.collect()), key=str)
    assert got == sorted([(2, "T0"), (None, "u0"), (1, ""), (1, ""), (None, ""), (4, "al")], key=str)
    assert keep_one(d.where("false")).count() == 0


def test_short_texts_of_one_template(docs, monkeypatch):
    """A bucket of many rows with small sets: blocks are bounded by rows."""
    import spanloom.llm.near_dedup as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 20)
    rnd = random.Random(7)
    texts = [f"dear {rnd.randrange(10**6)} your order has been sent today" for _ in range(90)] * 2
    got = near_duplicates(docs(*texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(list(enumerate(texts)))


def test_large_bucket_by_blocks(spark, docs, monkeypatch):
    import spanloom.llm.near_dedup as module

    monkeypatch.setattr(module, "BLOCK_SHINGLES", 800)
    monkeypatch.setattr(module, "SMALL", 3)
    rnd = random.Random(5)
    texts = variants(rnd, [f"t{i}" for i in range(80)], 70, 8)
    got = near_duplicates(docs(*texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(list(enumerate(texts)))


def test_links_of_blocks_are_fewer_than_rows(docs, monkeypatch):
    """Blocks of a large group of near copies don't return links for each pair of them."""
    import spanloom.llm.near_dedup as module

    made = []
    monkeypatch.setattr(module, "BLOCK_ROWS", 6)
    monkeypatch.setattr(module, "SMALL", 3)
    monkeypatch.setattr(module, "components", lambda edges: made.append(edges.count()) or components(edges))
    texts = variants(random.Random(9), [f"t{i}" for i in range(120)], 120, 3)
    got = near_duplicates(docs(*texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(list(enumerate(texts)))
    assert sum(made) < 5 * len(texts), made


def test_empty_table(spark, docs):
    assert near_duplicates(docs("x").where("false")).count() == 0


def test_query_matches_sql(same):
    assert same(queries.QUERIES["op8_minhash_near_dedup"], queries.ORACLE_SQL["op8_minhash_near_dedup"]) == 1000


def test_sql_has_the_results_stated_for_odd_rows(docs, duck):
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:39], "other"])
    rows = [" ".join(words), near, near, None, "", " \t\n", "two Words", "two words", "É x", "é x", "apart from all the others here"]
    df = docs(*rows, ids=[9, 7, None, 1, 2, 3, 4, 5, 6, 8, 7])
    got = {repr(tuple(r)) for r in near_duplicates(df).collect()}
    cursor = duck.cursor()
    cursor.execute("CREATE TEMP TABLE odd (doc_id BIGINT, text VARCHAR)")
    cursor.executemany("INSERT INTO odd VALUES (?, ?)", [(r.doc_id, r.text) for r in df.collect()])
    assert {repr(r) for r in cursor.execute(oracle_sql().replace("FROM documents", "FROM odd")).fetchall()} == got
