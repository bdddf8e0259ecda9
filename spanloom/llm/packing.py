"""Best-fit packing of token sequences with large-item matching.

A document's tokens are cut into pieces of the capacity; what is over is its
first piece.  Full pieces are sequences by themselves.  The others are packed:

* pieces over a third of the capacity are matched greedily, from the largest
  on, each with the largest one that still fits beside it: two at most share a
  sequence;
* smaller pieces, from the largest on, go where the gap left is the tightest
  that holds them; where none does, a new sequence is opened.

Lengths are whole numbers up to the capacity, so the plan depends on how many
pieces have each length and not on which they are.  It is made on the driver
from at most ``capacity`` counts, and says which ranks of which length go to
which sequences; its size depends on the capacity alone.  Pieces learn their
rank within their length from a window over (length, bucket) and the buckets'
running counts, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import lean, runs, ship, stage, utf8
from spanloom.llm.tokenise import ids_of

CAPACITY, END = 1024, 2
#: Ranks are dealt over 64 buckets for each length at least, and more where buckets would hold more than this.
BUCKET_ROWS = 1_000_000
#: Texts go to the encoder in runs of about so many bytes.
_CHUNK_BYTES = 500_000


@lean
def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = ids_of(path)
    for batch in batches:
        column = batch.column(1)
        for at, stop in runs(utf8(column)[1], _CHUNK_BYTES):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.batch([x or "" for x in column.slice(at, stop - at).to_pylist()]), at):
                raw, n = np.append(ids, end).astype("<u4").tobytes(), len(ids) + 1
                head = n % capacity or capacity
                cuts = [0, *range(head, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    encoder.clear()  # the worker lives on


def tokenise_and_cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece; a null text has the end token alone."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_cut, path=path, end=end, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, per sequence, first sequence, offset) for so many pieces of each length.

    Rank r of a length goes to sequence first + (r - first rank) // per at
    offset + length * ((r - first rank) % per).
    """
    rows, next_rank, next_bin = [], dict.fromkeys(counts, 0), 0
    left = {s: c for s, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    order: list[int] = []

    def put(size: int, n: int, per: int, first: int, offset: int) -> None:
        rows.append((size, next_rank[size], n, per, first, offset))
        next_rank[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    rising = large[::-1]
    for size in large:
        while size in left:
            mates = bisect_left(rising, capacity - size + 1)
            while mates and rising[mates - 1] not in left:
                rising.pop(mates - 1)
                mates -= 1
            mate = rising[mates - 1] if mates else 0
            if mate == size and left[size] < 2:
                lower = mates - 1
                while lower and rising[lower - 1] not in left:
                    rising.pop(lower - 1)
                    lower -= 1
                mate = rising[lower - 1] if lower else 0
            if not mate:
                n = left[size]
                put(size, n, 1, next_bin, 0)
                leave(capacity - size, next_bin, n)
            elif mate == size:
                n = left[size] // 2
                put(size, 2 * n, 2, next_bin, 0)
                leave(capacity - 2 * size, next_bin, n)
            else:
                n = min(left[size], left[mate])
                put(size, n, 1, next_bin, 0)
                put(mate, n, 1, next_bin, size)
                leave(capacity - size - mate, next_bin, n)
            next_bin += n
    for size in sorted(left, reverse=True):
        while size in left:
            at = bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first = capacity, next_bin
                bins = -(-left[size] // (capacity // size))
                next_bin += bins
            per = gap // size
            whole = min(bins, left[size] // per)
            if whole:
                put(size, whole * per, per, first, capacity - gap)
                leave(gap - per * size, first, whole)
            if whole < bins:
                rest = left.get(size, 0)  # fewer than one sequence takes
                if rest:
                    put(size, rest, rest, first + whole, capacity - gap)
                    leave(gap - rest * size, first + whole, 1)
                    whole += 1
                leave(gap, first + whole, bins - whole)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless from 0 in each sequence.

    ``pieces`` needs doc_id, piece and length (1 to ``capacity``), and should
    be a stored table, as it is read three times.  Repeated rows are pieces of
    their own; ties are in order of doc_id, piece and whatever else tells them
    apart; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(64, -(-total // BUCKET_ROWS))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    per_bucket = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("c"))
    first = F.sum("c").over(W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")
    offsets = per_bucket.withColumn("__before", first).drop("c")
    counts = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect()}  # at most capacity rows
    made = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)], "length long, __from long, __n long, __per long, __first long, __at long")
    rank = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start")) - 1
    ranked = dealt.withColumn("__rank", rank).join(offsets, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(F.broadcast(made), (ranked.length == made.length) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n"))).drop(made.length)
    step = F.col("__rank") - F.col("__from")
    return placed.select(
        *pieces.columns,
        (F.col("__first") + F.floor(step / F.col("__per"))).cast("long").alias("sequence_id"),
        (F.col("__at") + F.col("length") * (step % F.col("__per"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` names the tokenizer file; None takes the public 50k byte-level one.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(stage(tokenise_and_cut(docs, path, id_col, text_col, end, capacity), "pieces"), capacity)
