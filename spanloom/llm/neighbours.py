"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as the sum of one codeword from each of M codebooks over
all dimensions.  The codebooks are learned one after another on what the
earlier ones leave (the residuals), from a bounded sample; codes are found by a
beam search over the codebooks.  With the norm of the sum stored beside the
codes, a query's cosine to every row is M table lookups, from one table per
query of its products with all codewords.  The best of these are ranked again
by the exact cosine of the original vectors, in double precision.

Equal vectors are one candidate, with the few least ids that could be told.  A
row is filed in the list of its first codeword (of its first two in large
tables), and a query visits the lists nearest to it: as many as hold all but
MISSED of the nearest neighbours that queries of the sample have in it.  Rows
and the queries that visit their list meet there, in blocks of bounded size, so
what is shuffled grows with the rows: each is sent once for a block of queries,
and each query once for a list.  A list returns the rows whose estimate is at
least what the SHORTLIST-th best should have, judged by the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import lean, ship, stage, unstage

#: Vectors that the codebooks are learned from, at most.
SAMPLE = 20_000
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 8
#: Recall at 5 on 51,282 vectors of 64 dimensions: 0.99 with a shortlist of 400, 0.96 with 200, 0.91 with 100.
SHORTLIST, SHARD, BLOCK = 400, 16_384, 4_096
#: Nearest neighbours of the sample that the visited lists may lack; tables of more vectors have lists of two codewords.
MISSED, TWO_WORDS = 0.01, 4_000_000
#: The shortlist's place in the sample is moved back by so much, as the sample's estimate of it varies.
MARGIN = 1.3


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions, float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the sums) of unit vectors, by a beam over the books."""
        n = len(x)
        codes = np.zeros((n, 1, 0), np.uint8)
        left = x[:, None, :].astype(np.float32)
        for book in self.words:
            length = (book * book).sum(1)
            cost = (left * left).sum(2)[:, :, None] - 2 * left @ book.T + length
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            way, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, way], word[:, :, None].astype(np.uint8)], 2)
            left = left[rows, way] - book[word]
        final = np.argmin((left * left).sum(2), axis=1)
        rows = np.arange(n)
        return codes[rows, final], np.linalg.norm(x - left[rows, final], axis=1).astype(np.float32)


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 5) -> Codebooks:
    """Residual k-means over all dimensions, one book after another."""
    rng = np.random.default_rng(seed)
    left, out = x.astype(np.float32), []
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = np.argmin((book * book).sum(1) - 2 * left @ book.T, axis=1)
            counts = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[filled]
            book[filled] = np.add.reduceat(left[order], starts) / counts[filled][:, None]
        near = np.argmin((book * book).sum(1) - 2 * left @ book.T, axis=1)
        left = left - book[near]
        out.append(book)
    return Codebooks(np.stack(out))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def centres(books: Codebooks, two: bool) -> np.ndarray:
    first = books.words[0]
    return (first[:, None, :] + books.words[1][None, :, :]).reshape(-1, first.shape[1]) if two else first


def filed(codes: np.ndarray, words: int, two: bool) -> np.ndarray:
    """The list of each row."""
    return codes[:, 0].astype(np.int32) * words + codes[:, 1] if two else codes[:, 0].astype(np.int32)


def visits(x: np.ndarray, middle: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` lists nearest to each unit vector, in order."""
    far = (middle * middle).sum(1) - 2 * x.astype(np.float32) @ middle.T
    if n < far.shape[1]:
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return some[np.arange(len(x))[:, None], np.argsort(far[np.arange(len(x))[:, None], some], axis=1)]
    return np.argsort(far, axis=1)


def enough_visits(sample: np.ndarray, codes: np.ndarray, books: Codebooks, two: bool, k: int, queries: int = 400) -> int:
    """How many lists a query must visit for all but MISSED of its ``k`` nearest rows, by queries of the sample."""
    middle = centres(books, two)
    if len(sample) < 20 * k:
        return len(middle)
    asked = np.random.default_rng(3).permutation(len(sample))[:queries]
    own = filed(codes, books.words.shape[1], two)
    ranks = []
    for at in range(0, len(asked), 50):
        part = asked[at : at + 50]
        near = sample[part] @ sample.T
        near[np.arange(len(part)), part] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.argsort(visits(sample[part], middle, len(middle)), axis=1)
        ranks.append(place[np.arange(len(part))[:, None], own[best]].ravel())
    return int(np.quantile(np.concatenate(ranks), 1 - MISSED)) + 1


@dataclass
class Plan:
    books: Codebooks
    two: bool
    visits: int
    codes: np.ndarray  # of the sample, with the norms of their sums
    norms: np.ndarray
    place: int  # a query's threshold is the estimate of the sample's row at this place


def estimates(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Queries x rows: sums of lookups over the norm of the coded sum."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        out += tables[:, m][:, codes[:, m]]
    return out / np.maximum(norms, 1e-12)


def lookups(x: np.ndarray, books: Codebooks) -> np.ndarray:
    """Each query's products with all codewords: queries x books x words."""
    m, w, d = books.words.shape
    return (x.astype(np.float32) @ books.words.reshape(m * w, d).T).reshape(len(x), m, w)


@lean
def _encode(batches: Iterator[pa.RecordBatch], books: Codebooks, two: bool, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            codes, norms = books.encode(unit(_matrix(part.column(1), size)))
            yield pa.RecordBatch.from_arrays([pa.array(filed(codes, books.words.shape[1], two)), part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["list", "node", "codes", "norm"])


@lean
def _visit(batches: Iterator[pa.RecordBatch], plan: Plan, size: int) -> Iterator[pa.RecordBatch]:
    """Each query (node, embedding) becomes a row for every list that it visits, with its unit vector and threshold."""
    middle = centres(plan.books, plan.two)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            x = unit(_matrix(part.column(1), size)).astype("<f4")
            score = np.sort(estimates(lookups(x, plan.books), plan.codes, plan.norms), axis=1)
            least = score[:, max(0, score.shape[1] - plan.place)] if score.shape[1] else np.zeros(len(x), np.float32)
            least = np.where(plan.place >= score.shape[1], -np.inf, least) if score.shape[1] else np.full(len(x), -np.inf)
            lists = visits(x, middle, plan.visits)
            n = lists.shape[1]
            row = pa.array(np.repeat(np.arange(len(x)), n))
            vectors = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), part.column(0).take(row), vectors.take(row), pa.array(np.repeat(least, n).astype(np.float64))], names=["list", "asked", "vector", "least"])


def _scan(rows: pa.Table, queries: pa.Table, books: Codebooks, keep: int) -> pa.Table:
    """A block of queries against a shard of a list, by table lookups: the rows that reach the query's threshold, the best ``keep`` of them."""
    node, norms = rows["node"].to_numpy(), rows["norm"].to_numpy()
    codes = np.frombuffer(b"".join(x.as_py() for x in rows["codes"]), np.uint8).reshape(len(node), -1)
    asked, least = queries["asked"].to_numpy(), queries["least"].to_numpy()
    x = np.frombuffer(b"".join(v.as_py() for v in queries["vector"]), "<f4").reshape(len(asked), -1)
    out = [[], [], []]
    wide = max(1, min(64, (1 << 20) // max(1, len(node))))
    for at in range(0, len(asked), wide):
        part = slice(at, at + wide)
        score = estimates(lookups(x[part], books), codes, norms)
        good = (score >= least[part, None]) & (node[None, :] != asked[part, None])
        for q in np.flatnonzero(good.any(1)).tolist():
            some = np.flatnonzero(good[q])
            ids, values = _best(node[some], score[q, some], keep)
            out[0].append(np.full(len(ids), asked[at + q])), out[1].append(ids), out[2].append(values)
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return pa.table({"asked": join(out[0], np.int64), "node": join(out[1], np.int64), "estimate": join(out[2], np.float64)})


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` best by score, ties to smaller ids, in order of id."""
    if len(scores) > keep:
        edge = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        over, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        level = level[np.argsort(ids[level], kind="stable")[: keep - len(over)]]
        chosen = np.concatenate([over, level])
        ids, scores = ids[chosen], scores[chosen]
    order = np.argsort(ids, kind="stable")
    return ids[order], scores[order]


@lean
def _exact(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _matrix(batch.column(2), size), _matrix(batch.column(3), size)
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        score = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["asked", "node", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding of the rows that take part; vectors of float stay so, others are of double."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that ``is_query`` (a condition on vec_id) holds for.

    Score is the cosine in double precision; ties go to smaller ids.  Rows
    whose id or vector is null, whose vector is zero, empty or has a null or
    non-finite component, or has another dimension than most, take no part.
    Rows with one id are one vector.  With ``k`` candidates or fewer all are
    returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes[0]["d"]
    rows = rows.where(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = stage(rows.withColumn("h", F.xxhash64("embedding")), "vectors")
    # equal vectors: the k + 1 least ids can be told, as one of them may be the query's own
    first = W.partitionBy("h", "embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    nodes = stage(few.groupBy("h", "embedding").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    total = nodes.count()
    drawn = nodes if total <= SAMPLE else nodes.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < int(SAMPLE / total * (1 << 30)))
    sample = unit(np.array([r["embedding"] for r in drawn.select("embedding").toLocalIterator()], np.float64).reshape(-1, size)) if total else np.zeros((0, size))
    if not len(sample):  # a tiny share of a large table drew nothing
        sample = unit(np.array([r["embedding"] for r in nodes.select("embedding").limit(SAMPLE).collect()], np.float64))
    books, two = learn(sample), total > TWO_WORDS
    parts = [books.encode(sample[at : at + 1024]) for at in range(0, len(sample), 1024)]
    codes, norms = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    place = int(np.ceil(MARGIN * shortlist * len(sample) / total)) + 1
    plan = Plan(books, two, enough_visits(sample, codes, books, two, k), codes, norms, place)
    coded = stage(nodes.select("node", "embedding").mapInArrow(partial(_encode, books=books, two=two, size=size), "list int, node long, codes binary, norm float"), "codes")
    asked = stage(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h", "embedding").join(nodes.select("h", "embedding", "node"), ["h", "embedding"]).select("query_id", "node"), "asked")
    who = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "embedding")
    visiting = stage(who.mapInArrow(partial(_visit, plan=plan, size=size), "list int, asked long, vector binary, least double"), "visits")
    # at most 65,536 lists, of 12 bytes each
    counts = coded.groupBy("list").agg(F.count("*").alias("c")).join(visiting.groupBy("list").agg(F.count("*").alias("q")), "list")
    counts = F.broadcast(counts.select("list", F.ceil(F.col("c") / SHARD).cast("int").alias("shards"), F.ceil(F.col("q") / BLOCK).cast("int").alias("blocks")))
    deal = lambda column, n: F.pmod(F.xxhash64(column, F.lit("deal")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = coded.join(counts, "list").select("list", deal("node", "shards").alias("shard"), every("blocks").alias("block"), "node", "codes", "norm")
    right = visiting.join(counts, "list").select("list", every("shards").alias("shard"), deal("asked", "blocks").alias("block"), "asked", "vector", "least")
    meet = ("list", "shard", "block")
    rough = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(partial(_scan, books=books, keep=shortlist), "asked long, node long, estimate double")
    near = W.partitionBy("asked").orderBy(F.desc("estimate"), "node")
    short = stage(rough.withColumn("place", F.row_number().over(near)).where(F.col("place") <= shortlist).select("asked", "node"), "shortlists")
    unstage(coded, visiting)
    own = asked.select(F.col("node").alias("asked")).distinct().select("asked", F.col("asked").alias("node"))  # for its copies
    pairs = short.unionByName(own).join(nodes.select("node", F.col("embedding").alias("b")), "node").join(nodes.select(F.col("node").alias("asked"), F.col("embedding").alias("a")), "asked")
    scored = pairs.select("asked", "node", "a", "b").mapInArrow(partial(_exact, size=size), "asked long, node long, score double")
    top = W.partitionBy("asked").orderBy(F.desc("score"), "node")
    best = scored.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    told = best.join(nodes.select("node", "ids"), "node").select("asked", "score", F.explode("ids").alias("vec_id"))
    final = asked.withColumnRenamed("node", "asked").join(told, "asked").where("query_id <> vec_id").drop("asked")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
