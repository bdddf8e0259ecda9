import random
import zlib

import numpy as np
import pytest

import public_tokenizers
from spanloom.llm.packing import pack_documents, plan
from spanloom.llm.tokenise import Ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Ids(PATH)


def test_ids_equal_the_tokenizer(encoder):
    rnd = random.Random(12)
    bits = [*"abCDxyz 's t're'll'd'm've  \n\t\r  é12²½ª.,!?'\"-_\x1c\x00", "'s", "'ll ", " '", "  ", "日本", "🏢", "<|endoftext|>"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(4000)] + ["", "a" * 3000, " " * 500, "'", "it's they'RE"]
    whole = encoder.whole.encode_batch(texts, add_special_tokens=False)
    for t, a, b in zip(texts, whole, encoder.batch(texts), strict=True):
        assert a.ids == b.tolist(), t


def test_cache_can_start_again(encoder, monkeypatch):
    import spanloom.llm.tokenise as module

    monkeypatch.setattr(module, "CACHE", 3)
    texts = [f"some words {i} here" for i in range(50)]
    assert [x.tolist() for t in texts for x in encoder.batch([t])] == [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]


def bins_of(rows):
    bins = {}
    for size, first_rank, n, per, first, at in rows:
        for r in range(n):
            bins.setdefault(first + r // per, []).append((at + size * (r % per), size))
    return bins


@pytest.mark.parametrize("capacity", [10, 97, 1024])
def test_plans_are_whole_and_gapless(capacity):
    rnd = random.Random(capacity)
    for _ in range(60):
        counts = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(0, 40))}
        rows = plan(counts, capacity)
        for size in counts:
            ranks = sorted((f, n) for s, f, n, *_ in rows if s == size)
            assert sum(n for _, n in ranks) == counts[size] and all(a + n == b for (a, n), (b, _) in zip(ranks, ranks[1:]))
        for items in bins_of(rows).values():
            items.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[0][0] == 0
            assert items[-1][0] + items[-1][1] <= capacity and sum(3 * n > capacity for _, n in items) <= 2


def test_plan_is_close_to_the_bound_and_bounded():
    rnd = np.random.default_rng(13)
    sizes, counts = np.unique(rnd.integers(1, 1025, 200_000), return_counts=True)
    rows = plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)))
    used = max(f + -(-n // per) for _, _, n, per, f, _ in rows)
    assert used <= 1.01 * -(-int((sizes * counts).sum()) // 1024)
    assert len(rows) < 20_000
    huge = plan({s: 10**12 + s for s in range(1, 1025)})
    assert len(huge) < 20_000


def test_packed_documents(spark, docs, encoder):
    rnd = random.Random(14)
    texts = [None, "", "short", "same text", "same text"] + [" ".join(rnd.choices(["alpha", "beta's", "x1", "été"], k=rnd.randint(1, 3000))) for _ in range(40)]
    rows = pack_documents(docs(*texts, extra=True)).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*encoder.whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == 1024 for r in pieces[1:]) and (len(ids) > 1024 or len(pieces) == 1)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for items in bins.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= 1024
    assert pack_documents(docs("x").where("false")).count() == 0


def test_repeated_rows_are_packed_each(spark, docs):
    rows = pack_documents(docs("a b c", "a b c", ids=[5, 5])).collect()
    assert len(rows) == 2 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 2
