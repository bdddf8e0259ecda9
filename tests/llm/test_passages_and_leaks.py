import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from spanloom.llm import decontaminate as D
from spanloom.llm import passages as P
from spanloom.llm.common import utf8

ITEM = "the quick brown fox jumps over a lazy dog while seven wizards quietly pack boxes with liquor jugs and odd maps"


def noise(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 8))) for _ in range(n))


def sequences(*texts):
    s, at = P.shingle_hashes(*P.word_hashes(*utf8(pa.array(texts))), 5)
    return [s[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def near(a, b):
    """All pairs of starts whose windows are near duplicates, plainly."""
    sets = [[set(x[i : i + P.LEAST].tolist()) for i in range(len(x) - P.LEAST + 1)] for x in (a, b)]
    return {(i, j) for i, p in enumerate(sets[0]) for j, q in enumerate(sets[1]) if 100 * len(p & q) >= 75 * len(p | q)}


def connected(rows):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for r in rows:
        p, q = find(r["doc_id"]), find(r["other_id"])
        lead[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(lead)}


def test_windows_are_the_cartesian_trees_wide_nodes():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 1 << 60, 400, dtype=np.uint64)
    offsets = np.array([0, 30, 230, 400])
    for k, (nodes, owner, low, high) in enumerate(P.windows(x, offsets)):
        with np.errstate(over="ignore"):
            value = P.mix64((x ^ P._B[k]) * P._A[k])
        expected = set()
        for t in range(3):
            for c in range(offsets[t], offsets[t + 1]):
                left = c
                while left > offsets[t] and value[left - 1] > value[c]:
                    left -= 1
                right = c
                while right + 1 < offsets[t + 1] and value[right + 1] > value[c]:
                    right += 1
                if right - left + 1 >= P.LEAST:
                    expected.add((c, t, max(left, c - P.LEAST + 1), min(c, right - P.LEAST + 1)))
        assert set(zip(*(v.tolist() for v in (nodes, owner, low, high)), strict=True)) == expected


def test_overlay_files_the_rarest_keys_of_starts_in_enough_windows():
    rnd = np.random.default_rng(5)
    rows = []  # node, key, first, last, hash function, count
    for node in (3, 8, 9):
        for k in range(P.HASHES):
            at = 0
            while at < 60:
                end = at + int(rnd.integers(1, 15))
                if rnd.random() < 0.6:
                    rows.append((node, int(rnd.integers(1, 1 << 62)), at, end - 1, k, int(rnd.integers(2, 9))))
                at = end
    place = [r[3] for r in rows]
    rows = sorted((n, p << 16 | (p - a) << 10 | (p - b) << 4 | k, key, c, a, b) for (n, key, a, b, k, c), p in zip(rows, place, strict=True))
    node, span, key, count = (np.array([r[i] for r in rows]) for i in range(4))
    got = {int(r): (int(a), int(b)) for r, a, b in zip(*P.overlay(node, key, span, count), strict=True)}
    expected = {}
    for n in (3, 8, 9):
        for start in range(90):
            held = [(r[3], r[2], i) for i, r in enumerate(rows) if r[0] == n and r[4] <= start <= r[5]]
            for _, _, i in sorted(held)[: max(0, len(held) - P.AGREE + 1)] if len(held) >= P.AGREE else []:
                expected.setdefault(i, []).append(start)
    assert got == {i: (min(v), max(v)) for i, v in expected.items()} and got


def test_repeated_passages(spark, docs):
    rnd = random.Random(8)
    shared, edited = noise(rnd, 60), noise(rnd, 80).split()
    changed = list(edited)
    changed[40] = "changed"
    texts = [f"{noise(rnd, 30)} {shared} {noise(rnd, 20)}", f"{noise(rnd, 90)} {shared}", f"{shared} {noise(rnd, 10)}", " ".join(edited), noise(rnd, 5) + " " + " ".join(changed)]
    texts += [noise(rnd, 200) for _ in range(8)] + [" ".join(shared.split()[:30]) + " " + noise(rnd, 50), None, "", "short text"]
    whole = noise(rnd, 55)
    texts += [whole, whole.upper(), whole]
    rows = P.repeated_passages(docs(*texts, extra=True)).collect()
    n = len(texts)
    assert connected(rows) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, n - 3: n - 3, n - 2: n - 3, n - 1: n - 3}
    place = {0: (30, 90), 1: (90, 150), 2: (0, 60)}
    for r in rows:
        if r["doc_id"] in place:
            assert (r["start_word"], r["end_word"], r["other_start_word"], r["other_end_word"], r["similarity"]) == (*place[r["doc_id"]], *place[r["other_id"]], 1.0)
    assert P.repeated_passages(docs("x").where("false")).count() == 0


def test_odd_rows(docs):
    rnd = random.Random(18)
    text = noise(rnd, 70)
    got = P.repeated_passages(docs(text, text, text, text + " more", None, ids=[1, 1, None, 1, 1], extra=True)).collect()
    assert all(r["doc_id"] == r["other_id"] == 1 for r in got)
    long = docs("word " * 60_000, "word " * 300 + noise(rnd, 20), noise(rnd, 30_000))
    assert connected(P.repeated_passages(long).collect()) == {0: 0, 1: 0}


def test_each_document_of_a_pair_has_a_row_in_the_query(spark, docs, monkeypatch):
    from spanloom.llm import queries

    rnd = random.Random(30)
    shared = noise(rnd, 60)
    df = docs(f"{noise(rnd, 9)} {shared}", f"{shared} {noise(rnd, 7)}", noise(rnd, 80))
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["other_id"], r["other_start_word"]) for r in queries.op5_compact_windows(spark, "").collect()}
    assert got == {(0, 9, 69, 1, 0), (1, 0, 60, 0, 9)}


def test_every_exact_repeat_is_found(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(sf).select("doc_id", "text")
    table = sorted((r["doc_id"], r["text"]) for r in df.collect())
    s = sequences(*(t for _, t in table))
    where = defaultdict(set)
    for k, x in enumerate(s):
        for i in range(len(x) - P.LEAST + 1):
            where[x[i : i + P.LEAST].tobytes()].add(table[k][0])
    rows = P.repeated_passages(df).collect()
    lead = connected(rows)
    groups = [g for g in where.values() if len(g) > 1]
    assert groups and sum(len({lead.get(i, -i - 1) for i in g}) == 1 for g in groups) >= 0.99 * len(groups)
    assert all(r["similarity"] >= 0.75 for r in rows)


def test_recall_of_edited_passages(docs):
    """Pairs of texts with one passage, of every length and number of edits that leaves a near-duplicate window."""
    rnd, texts, kinds = random.Random(20), [], {}
    for words, edits in ((50, 0), (50, 1), (52, 1), (60, 1), (60, 2), (80, 2), (80, 3), (120, 4), (200, 8)):
        for _ in range(30):
            a = noise(rnd, words).split()
            b = list(a)
            for at in sorted(rnd.sample(range(words), edits), reverse=True):
                b[at : at + 1] = rnd.choice([["changed"], [], [b[at], "more"]])
            pair = [f"{noise(rnd, rnd.randint(0, 60))} {' '.join(x)} {noise(rnd, rnd.randint(0, 60))}" for x in (a, b)]
            if near(*sequences(*pair)):
                kinds[len(texts) + 1] = (words, edits)
                texts += pair
    found = {r["doc_id"]: r["other_id"] for r in P.repeated_passages(docs(*texts)).collect()}
    assert all(found[i] == i - 1 for i in found)
    for kind in set(kinds.values()):
        own = [i in found for i, k in kinds.items() if k == kind]
        assert sum(own) >= 0.9 * len(own), (kind, sum(own), len(own))
    assert len(kinds) > 180


def test_texts_are_compared_where_the_first_of_a_group_lacks_the_passage(docs, monkeypatch):
    rnd = random.Random(14)
    texts, expected = [], {}
    for k in range(24):
        words = noise(rnd, 52).split()
        held = words[: rnd.choice([40, 42])] if k % 2 else words[-40:]
        expected |= {len(texts) + 1: len(texts) + 1, len(texts) + 2: len(texts) + 1}
        texts += [f"{noise(rnd, 20)} {' '.join(held)} {noise(rnd, 20)}"] + [f"{noise(rnd, 20)} {' '.join(words)} {noise(rnd, 20)}" for _ in range(2)]
    assert connected(P.repeated_passages(docs(*texts)).collect()) == expected
    monkeypatch.setattr(P, "PAIRS", 0)
    monkeypatch.setattr(P, "ROWS", 2)
    assert connected(P.repeated_passages(docs(*texts)).collect()) == expected


def test_a_repeated_line_is_reported_wherever_it_stands():
    rnd = random.Random(12)
    line, other = noise(rnd, 60), noise(rnd, 30)
    a, b = sequences(" ".join(f"{noise(rnd, 50)} {line}" for _ in range(12)), " ".join(f"{line} {other}" for _ in range(9)))
    at = [76 + 110 * k for k in range(12)]
    x = np.array([(p - 26, p - 16, p) for p in at])
    y = np.array([(90 * k, 10 + 90 * k, 26 + 90 * k) for k in range(9)])
    found, led = P.compare(P.narrow(a), P.narrow(b), [(x, y)])
    assert led.all() and {p[0] // 110 for p in found} == set(range(12))


def leaks(docs, *texts, items=(ITEM,)):
    spark = docs("x").sparkSession
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    return sorted(D.find_leaks(docs(*texts, extra=True), bench).collect())


def test_leaks(spark, docs):
    rnd = random.Random(9)
    words = ITEM.split()
    texts = [
        f"é {noise(rnd, 30)} {ITEM} {noise(rnd, 3)}",
        ITEM.upper().replace(" ", "\n\n- ") + "!",
        noise(rnd, 20) + " " + ITEM.replace("brown", "browm").replace("wizards", "wizard") + " " + noise(rnd, 9),
        " ".join(words[:8]) + " " + noise(rnd, 20) + " " + " ".join(words[-8:]),
        noise(rnd, 400),
        None,
        "",
        f"{ITEM} {noise(rnd, 5)} {ITEM}",
    ]
    got = leaks(docs, *texts)
    assert [(r["doc_id"], r["edits"]) for r in got] == [(0, 0), (1, 0), (2, 2), (7, 0), (7, 0)]
    first = got[0]
    assert texts[0][first["start"] : first["end"]] == ITEM
    assert [r["item_id"] for r in leaks(docs, ITEM, items=(None, "", "too short", "?!", ITEM))] == [4]
    assert leaks(docs, ITEM, items=()) == [] and D.find_leaks(docs("x").where("false"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_edited_items_equal_plain_alignment():
    rnd = random.Random(10)
    index = D.Index([(0, ITEM)])
    table, body = index.table(), index.items[0].decode()

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row = row, [i]
            for j, d in enumerate(text, 1):
                row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
        return min(row)

    for _ in range(60):
        letters = list(body)
        for _ in range(rnd.randint(0, 14)):
            k = rnd.randrange(len(letters))
            letters[k : k + 1] = rnd.choice([[], ["z"], [letters[k], "q"]])
        text = noise(rnd, 10) + " " + "".join(letters) + " " + noise(rnd, 10)
        data, offsets = utf8(pa.array([text]))
        got = D._matches(offsets, index, table, D.normal(data, offsets))
        best = distance(body, D.normalise(data, offsets)[0].tobytes().rstrip(b"\0").decode())
        assert bool(got) == (best <= index.edits[0])
        if got:
            assert min(r[4] for r in got) == best


def test_short_items_are_held_as_whole_words(docs):
    question = "What is the capital of Peru?"
    texts = [f"So: what  is the CAPITAL of peru! {question}", "what is the capital of perugia", "capital of peru", "xcapital of peru", "yes, and yes", "eyes", "what is the capital of persia"]
    got = leaks(docs, *texts, items=(question, "capital of Peru", "Yes"))
    assert [(r["doc_id"], r["item_id"], texts[r["doc_id"]][r["start"] : r["end"]].lower()) for r in got] == [
        (0, 0, "what  is the capital of peru"), (0, 0, "what is the capital of peru"), (0, 1, "capital of peru"), (0, 1, "capital of peru"), (2, 1, "capital of peru"), (4, 2, "yes"), (4, 2, "yes")
    ]


def test_blocks_of_items_change_nothing(docs, monkeypatch):
    rnd = random.Random(11)
    items = [noise(rnd, 15) for _ in range(6)]
    texts = [f"{noise(rnd, 9)} {x}" for x in items]
    whole = leaks(docs, *texts, items=items)
    monkeypatch.setattr(D, "BLOCK_CHARS", 10)
    assert leaks(docs, *texts, items=items) == whole and len(whole) == 6
