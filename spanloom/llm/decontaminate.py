"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared without case, punctuation and the amount of white
space.  An item of m bytes that a text holds with at most e edits (RATE of m)
shares at least m + 1 - q - q * e of its q-grams with it, on diagonals that lie
within e of one another.  Hits are counted in cells of e + 1 diagonals, two
neighbouring cells at a time, so that bands overlap and no run of diagonals is
cut.  The grams that most items have add hits and no evidence, so each item
keeps its rarest ones only, as many as leave SPARE shared ones after e edits;
the lemma's bound is lowered by those left out, and stays exact.

Bands that meet the bound are verified by a banded alignment of the whole item.
Short items say little, so edits would match anything: those under EXACT bytes
count where they stand unedited, as whole words.  Items go to the executors in
blocks of a fixed size, BLOCKS of them with each pass over the texts; tasks
index them, one pass normalises a text once, and the number of passes grows with
the benchmark's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BLOCK_BYTES, lean, runs, ship, utf8

Q, RATE, SPARE = 8, 0.08, 12
#: Items with fewer bytes after normalisation are sought without edits.
EXACT = 32
#: A block's items have about so many bytes, and their index 16 times as many; so many blocks go with one pass.
BLOCK_CHARS, BLOCKS = 1_000_000, 4
_BITS = 21
_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = 32
_MAP[48:58] = np.arange(48, 58)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place of each in ``data``, offsets): lower case, runs of anything but letters and digits as one space, a zero byte after each text."""
    low = _MAP[data]
    space = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[firsts] = True
    place = np.flatnonzero(keep)
    counts = np.searchsorted(place, offsets)
    out = np.zeros(len(place) + len(offsets) - 1, np.uint8)
    where = np.zeros(len(out), np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    at = np.arange(len(place)) + owner
    out[at], where[at] = low[place], place
    return out, where, counts + np.arange(len(offsets))


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on, as one number; Q is 8."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


class Index:
    """The kept grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.items = [], []
        for i, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            body = normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" \0")
            if body:
                self.ids.append(i)
                self.items.append(body)
        self.tiny = [k for k, b in enumerate(self.items) if len(b) < Q]
        every = [grams(np.frombuffer(b, np.uint8)) for b in self.items]
        values, inverse, common = np.unique(np.concatenate(every), return_inverse=True, return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
        at, gram, item, place = 0, [], [], []
        self.edits, self.bound = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        for k, g in enumerate(every):
            m = len(self.items[k])
            e = min(int(RATE * m), (m - Q) // Q) if m >= EXACT else 0
            kept = len(g) if m < EXACT else min(len(g), Q * e + max(SPARE, len(g) // 4))
            rare = np.sort(np.argsort(common[inverse[at : at + len(g)]], kind="stable")[:kept])
            at += len(g)
            self.edits[k], self.bound[k] = e, max(1, kept - Q * e)
            gram.append(g[rare]), item.append(np.full(kept, k)), place.append(rare)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        gram, item, place = join(gram, np.uint64), join(item, np.int32), join(place, np.int32)
        order = np.argsort(gram, kind="stable")
        gram, self.item, self.place = gram[order], item[order], place[order]
        self.gram, self.first, self.count = np.unique(gram, return_index=True, return_counts=True)

    def table(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[_slot(self.gram)] = True
        return out


def align(item: bytes, text: bytes, low: int, width: int, limit: int) -> tuple[int, int]:
    """(edits, end): the item's best whole alignment that begins on diagonals low to low + width - 1 of ``text``.

    The band is widened by ``limit`` on both sides, as an alignment with so few
    edits can't leave it.  Edits over ``limit`` are returned as limit + 1.
    """
    far, span = limit + 1, width + 2 * limit
    low -= limit
    padded = np.zeros(len(item) + span + 2, np.uint8)
    a, b = max(0, low), min(len(text), low + len(padded))
    if a < b:
        padded[a - low : b - low] = np.frombuffer(text[a:b], np.uint8)
    steps = np.arange(span)
    ok = (low + steps >= 0) & (low + steps <= len(text))
    row = np.where(ok & (steps >= limit) & (steps < limit + width), 0, far)
    for i, c in enumerate(item):
        across = row + (padded[i : i + span] != c)
        across = np.where((low + i + steps >= 0) & (low + i + steps < len(text)), across, far)
        down = np.append(row[1:], far) + 1
        best = np.minimum(across, down)
        row = np.minimum(np.minimum.accumulate(best - steps) + steps, far)
        if row.min() >= far:
            return far, -1
    k = int(np.argmin(row))
    return int(row[k]), low + len(item) + k


def _words_at(text: bytes, item: bytes, low: int, high: int) -> int:
    """Where the item stands between low and high as whole words, or -1."""
    while (low := text.find(item, low, high)) >= 0:
        if text[low - 1 : low] in (b"", b" ") and text[low + len(item) : low + len(item) + 1] in (b"", b" "):
            return low
        low += 1
    return -1


Normal = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def normal(data: np.ndarray, offsets: np.ndarray) -> Normal:
    body, where, at = normalise(data, offsets)
    return body, where, at, grams(body)


def _matches(offsets: np.ndarray, index: Index, table: np.ndarray, texts: Normal) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first byte, end byte, edits) of the verified regions, bytes of the text as given."""
    body, where, at, g = texts
    whole, out, seen = body.tobytes(), [], set()

    def add(t: int, i: int, a: int, b: int, edits: int) -> None:
        if (t, i, b) not in seen:
            seen.add((t, i, b))
            begin = int(at[t])
            out.append((t, i, int(where[begin + a] - offsets[t]), int(where[begin + b - 1] - offsets[t]) + 1, edits))

    for i in index.tiny:
        item, low = index.items[i], 0
        while (low := whole.find(item, low)) >= 0:
            t = int(np.searchsorted(at, low, side="right")) - 1
            begin, end = int(at[t]), int(at[t + 1]) - 1
            a = _words_at(whole[begin:end], item, low - begin, low - begin + len(item))
            if a >= 0:
                add(t, i, a, a + len(item), 0)
            low += 1
    hit = np.flatnonzero(table[_slot(g)])
    row = np.searchsorted(index.gram, g[hit])
    row[row == len(index.gram)] = 0
    exact = index.gram[row] == g[hit] if len(index.gram) else np.zeros(len(row), bool)
    hit, row = hit[exact], row[exact]
    count = index.count[row]
    if not len(hit):
        return out
    entry = np.repeat(index.first[row] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    item, place = index.item[entry].astype(np.int64), index.place[entry]
    start = np.repeat(hit, count) - place
    width = index.edits[item] + 1
    ahead = max(map(len, index.items)) + 2  # an item's start may lie before the block
    cell = np.floor_divide(start, width) + ahead
    base = len(body) + ahead + 4
    key, found = np.unique(item * base + cell, return_counts=True)
    both = found.copy()
    both[:-1] += np.where(key[1:] == key[:-1] + 1, found[1:], 0)
    good = key[both >= index.bound[key // base]]
    for k in good.tolist():
        i, c = divmod(k, base)
        e = int(index.edits[i])
        low, wide = (c - ahead) * (e + 1), 2 * (e + 1)
        text = int(np.searchsorted(at, max(0, low + wide // 2 + len(index.items[i]) // 2), side="right")) - 1
        for t in {max(0, text - 1), min(text, len(at) - 2), min(text + 1, len(at) - 2)}:
            begin, end = int(at[t]), int(at[t + 1]) - 1
            if low + wide + len(index.items[i]) < begin or low > end:
                continue
            segment = whole[begin:end]
            find = _words_at if len(index.items[i]) < EXACT else bytes.find
            a = find(segment, index.items[i], max(0, low - begin), max(0, low - begin) + wide + len(index.items[i]))
            if a >= 0:
                edits, b = 0, a + len(index.items[i])
            elif len(index.items[i]) < EXACT:
                continue
            else:
                edits, b = align(index.items[i], segment, low - begin, wide, e)
                if edits > e:
                    continue
                back, a = align(index.items[i][::-1], segment[::-1], len(segment) - b, 1, edits)
                a = len(segment) - a if back <= edits else max(0, b - len(index.items[i]))
            add(t, i, a, b, edits)
    return out


Items = list[tuple[int, str]]


def _passes(benchmark: DataFrame) -> Iterator[list[Items]]:
    """The blocks of items for one pass after another; the driver holds those of one pass, and plans hold all."""
    blocks, items, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        items.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_CHARS:
            blocks.append(items)
            items, size = [], 0
            if len(blocks) == BLOCKS:
                yield blocks
                blocks = []
    if items:
        blocks.append(items)
    if blocks:
        yield blocks


def _indexed(blocks: list[Items]) -> list[tuple[Index, np.ndarray]]:
    return [(x, x.table()) for x in map(Index, blocks)]


@lean
def _report(batches: Iterator[pa.RecordBatch], blocks: list[Items]) -> Iterator[pa.RecordBatch]:
    indexes = _indexed(blocks)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in runs(offsets, BLOCK_BYTES):
            part = data[offsets[a] : offsets[b]]
            inner = offsets[a : b + 1] - offsets[a]
            texts = normal(part, inner)
            for index, table in indexes:
                rows = _matches(inner, index, table, texts)
                if not rows:
                    continue
                point = lambda t, x: int(((part[inner[t] : inner[t] + x] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([a + r[0] for r in rows])),
                        pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                        pa.array([point(r[0], r[2]) for r in rows], pa.int64()),
                        pa.array([point(r[0], r[3]) for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.int32()),
                        pa.array([len(index.items[r[1]]) for r in rows], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "start", "end", "edits", "item_length"],
                )


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits, item_length: where texts hold benchmark items.

    start and end are code points of the text, end exclusive.  An item counts
    as held where at most 8 % of its normalised bytes are edited, or none where
    it has less than 32.  Null and empty texts hold nothing, and null items and
    such without a letter or digit are not held; a text that holds an item twice, and a row that is repeated, has a
    row for each; empty tables give no rows.  Of ``benchmark`` only item_id and
    text are read, of ``docs`` the two columns named.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits int, item_length int"
    out = None
    for blocks in _passes(benchmark):
        part = rows.mapInArrow(partial(_report, blocks=blocks), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


@lean
def _clean(batches: Iterator[pa.RecordBatch], blocks: list[Items], text_at: int) -> Iterator[pa.RecordBatch]:
    indexes = _indexed(blocks)
    for batch in batches:
        data, offsets = utf8(batch.column(text_at))
        keep = np.ones(batch.num_rows, bool)
        for a, b in runs(offsets, BLOCK_BYTES):
            inner = offsets[a : b + 1] - offsets[a]
            texts = normal(data[offsets[a] : offsets[b]], inner)
            for index, table in indexes:
                keep[[a + r[0] for r in _matches(inner, index, table, texts)]] = False
        yield batch.filter(pa.array(keep))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whole and in place: nothing is shuffled.

    Items are held as in ``find_leaks``.  Null and empty texts stay; repeated
    rows have one fate; without items all rows stay; empty tables give no rows.
    """
    ship(docs.sparkSession)
    for blocks in _passes(benchmark):
        docs = docs.mapInArrow(partial(_clean, blocks=blocks, text_at=docs.columns.index(text_col)), docs.schema)
    return docs
