"""MinHash near-duplicate detection by a multi-index Hamming join.

A text's set is its distinct five-word shingles.  Its signature is K minima,
one per hash function, each kept as one 16-bit symbol.  Two signatures that
differ in at most D symbols are found with certainty: the K symbols are split
into M chunks, and as D < M * (E + 1) some chunk differs in at most E of its
symbols (pigeonhole), so for every chunk all ways of leaving E of its symbols
out are enumerated as keys, and such a pair shares a key.  With K = 40, D = 19,
M = 10 and E = 1 a pair of Jaccard similarity 0.75 is within D but for a
chance of 6 in 10,000, and one of 0.8 but for 1 in 100,000.

Pairs are confirmed on the full sets.  They are not enumerated inside a bucket:

1. Equal sets become one node, named by a 64-bit hash of the set, whatever the
   number and the ids of their rows.
2. In every bucket the least node is the pivot; each node is first compared
   with the one pivot that it shares most buckets with.
3. What is confirmed is merged into components.  Only pairs of a bucket that
   are still in different components can add anything.  In small buckets they
   are compared as pairs.  A large one is cut into blocks of a bounded number
   of shingles, and a block is compared as the product of its incidence matrix,
   which returns no more links than it takes to join what is linked: first
   every block with itself, which returns fewer links than the bucket has
   rows, then two blocks at a time for what is still apart.  The pairs of a
   large bucket are never rows.  No bucket is capped and no partner is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import in_filter, lean, membership_filter, mix64, runs, seeds, ship, stage, unstage, utf8
from spanloom.llm.components import components
from spanloom.llm.shingles import shingle_hashes, sorted_sets, word_hashes

HASHES, CHUNKS, ERRORS, DISTANCE, WORDS = 40, 10, 1, 19, 5
#: A bucket of so many nodes is compared by pairs, a larger one by blocks of about so many rows and shingles.
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 16, 256, 250_000
_A, _B = seeds(HASHES, 21) | np.uint64(1), seeds(HASHES, 22)


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x K symbols of 16 bits; a text without shingles gets zeros."""
    counts = np.diff(offsets)
    out = np.zeros((len(counts), HASHES), "<u2")
    full = np.flatnonzero(counts)
    if len(full):
        begins = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                low = np.minimum.reduceat((shingles ^ _B[k]) * _A[k], begins)
                out[full, k] = ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")
    return out


def _sets_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, shingles, their offsets, distinct ones in order, their offsets, hash of each set) for runs of texts."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        shingles, begins = shingle_hashes(words, at, WORDS)
        values, at = sorted_sets(shingles, begins)
        sums = np.diff(at).astype(np.uint64)
        full = np.flatnonzero(sums)
        if len(full):
            with np.errstate(over="ignore"):
                for i in (0, 1):
                    x = values * (_A[i] ^ _B[i + 2] | np.uint64(1))
                    sums[full] = mix64(sums[full] + np.add.reduceat(x ^ (x >> np.uint64(29)), at[:-1][full]))
        yield a, b, shingles, begins, values, at, sums.view(np.int64)


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, shingles, begins, _, at, node in _sets_of(batch.column(1)):
            sign = signatures(shingles, begins)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(at)), pa.array(node), pa.array([x.tobytes() for x in sign], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "node", "signature"],
            )


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, node, signature) per row; text_key is a 64-bit hash of the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))
    return rows.mapInArrow(_sign, "doc_id long, text_key long, n_shingles long, node long, signature binary")


def text_key(column: str):
    return F.xxhash64(F.col(column).cast("string"))


def keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n): every chunk of the signature with every choice of E symbols left out."""
    from itertools import combinations

    per = HASHES // CHUNKS
    made = []
    for c in range(CHUNKS):
        for out in combinations(range(per), ERRORS):
            parts = [F.substring("signature", 2 * (c * per + i) + 1, 2) for i in range(per) if i not in out]
            made.append(F.xxhash64(F.lit(c), F.lit(sum(1 << i for i in out)), *parts))
    return nodes.select(F.explode(F.array(*made)).alias("key"), "node", "n")


@lean
def _sets(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """node, members of the texts whose key the filter passes, each set once for a task."""
    seen: set[int] = set()
    for batch in batches:
        batch = batch.filter(pa.array(in_filter(bits, batch.column(1).to_numpy(zero_copy_only=False))))
        for _, _, _, _, values, at, node in _sets_of(batch.column(0)):
            rows = []
            for i in np.flatnonzero(np.diff(at) > 0).tolist():
                if int(node[i]) not in seen:
                    seen.add(int(node[i]))
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array([values[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "members"])


@lean
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, v, set of u, set of v become u, v, whether 100 * intersection >= 75 * union."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            good.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["u", "v", "linked"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, linked) for pairs (u, v) of nodes, on their full sets."""
    first = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    second = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(_confirm, "u long, v long, linked boolean")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The size of each pair's intersection, as a matrix; columns are taken in runs, so memory is bounded by the rows."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    rank = np.cumsum(counts > 1) - 1
    useful = counts[inverse] > 1
    owner, column = owner[useful], rank[inverse[useful]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(counts[counts > 1].size)
    for low in range(0, width, 4096):
        x, y = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((n, min(4096, width - low)), np.float32)
        part[owner[x:y], column[x:y] - low] = 1
        out += part @ part.T
    return out


def _block(rows: pa.Table) -> pa.Table:
    """Links between components within a pair of blocks: as many as it takes to join what is linked."""
    component = rows["component"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["members"].combine_chunks()]
    size = np.array([len(x) for x in sets], np.float32)
    both = shared_counts(sets)
    linked = 175 * both >= 75 * (size[:, None] + size[None, :])  # 100 * shared >= 75 * all of them
    linked |= component[:, None] == component[None, :]
    label = component.copy()
    while True:
        lower = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        if (lower == label).all():
            break
        label = lower
    pairs = np.unique(np.stack([component, label], 1)[component != label], axis=0).reshape(-1, 2)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def _could(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= 75 * greatest({a}, {b})"


def link_nodes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the nodes that share a bucket with another; a component is its least node.

    ``nodes`` has node, n, signature and the text_key of a text with the set; ``texts`` has texts.
    """
    every = keys(nodes)
    shared = every.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("pivot"), F.min_by("n", "node").alias("pivot_n")).where("c > 1").drop("c")
    kept = stage(every.join(shared, "key"), "buckets")
    wanted = stage(kept.select("node").distinct(), "wanted")
    held = stage(nodes.join(wanted, "node", "left_semi").select("text_key"), "texts")
    # the filter is asked by the hash of the key
    sets = texts.select("text", F.xxhash64(text_key("text")).alias("slot")).mapInArrow(partial(_sets, bits=membership_filter(held, "text_key")), "node long, members binary")
    sets = stage(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members")), "sets")
    first = kept.where("node <> pivot").where(_could("n", "pivot_n")).groupBy(F.col("node").alias("v"), F.col("pivot").alias("u")).count()
    first = first.groupBy("v").agg(F.max(F.struct("count", (-F.col("u")).alias("u"))).alias("x")).select((-F.col("x.u")).alias("u"), "v")
    done = stage(confirm(first, sets).where("linked").select("u", "v"), "confirmed")
    labels = stage(wanted.join(components(done), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    unstage(done, wanted, held)
    opened = _open(kept.select("key", "node", "n"), labels)
    unstage(kept)
    # large buckets dealt into groups of a block's size: most of what is linked is merged before two blocks at a time are compared
    dealt = opened.where(f"size > {SMALL}").join(sets, "node").withColumn("part", _salted("size", "shingles"))
    labels = _merged(labels, dealt.select("key", "part", "component", "members").groupBy("key", "part").applyInArrow(_block, "u long, v long"))
    still = _open(opened.select("key", "node", "n"), labels)
    unstage(opened)
    opened = still
    small = opened.where(f"size <= {SMALL}")
    other = small.select("key", F.col("node").alias("w"), F.col("n").alias("m"), F.col("component").alias("other"))
    pairs = small.join(other, "key").where("component < other").where(_could("n", "m")).select(F.col("node").alias("u"), F.col("w").alias("v")).distinct()
    linked = confirm(pairs, sets).where("linked").select("u", "v")
    for end in ("u", "v"):
        linked = linked.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end).drop(end).withColumnRenamed(f"{end}_in", end)
    large = opened.where(f"size > {SMALL}").join(sets, "node")
    i_of, j_of = _blocks("open", "open_shingles"), _blocks("size", "shingles")
    asked = large.where("component <> main").select("key", _salted("open", "open_shingles").alias("i"), F.explode(F.sequence(F.lit(0), j_of - 1)).alias("j"), "component", "members")
    others = large.select("key", F.explode(F.sequence(F.lit(0), i_of - 1)).alias("i"), _salted("size", "shingles").alias("j"), "component", "members")
    blocks = asked.unionByName(others).groupBy("key", "i", "j").applyInArrow(_block, "u long, v long")
    out = _merged(labels, linked.select("u", "v").unionByName(blocks))
    unstage(sets, opened)
    return out


def _blocks(rows: str, shingles: str):
    return F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _salted(rows: str, shingles: str):
    return F.pmod(F.xxhash64("node", F.lit("block")), _blocks(rows, shingles)).cast("int")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after links between components; the table before is removed."""
    more = stage(links.distinct(), "links")
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("into"))
    out = stage(labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels")
    unstage(labels, more)
    return out


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the component, the largest component's name and the sizes."""
    placed = stage(rows.join(labels, "node"), "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = F.max(F.struct("c", "component", "s"))
    crossed = sizes.groupBy("key").agg(F.sum("c").alias("size"), F.sum("s").alias("shingles"), main.alias("x")).where("x.c < size")
    crossed = crossed.select("key", "size", "shingles", F.col("x.component").alias("main"), (F.col("size") - F.col("x.c")).alias("open"), (F.col("shingles") - F.col("x.s")).alias("open_shingles"))
    out = stage(placed.join(crossed, "key"), "open")
    unstage(placed)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node) of every row, and (node, rows, low, component, component_id) of every set that isn't empty."""
    signed = stage(sign(docs, id_col, text_col), "signatures")
    groups = signed.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.min("doc_id").alias("low"), F.count("*").alias("rows"), F.min("text_key").alias("text_key"))
    groups = stage(groups, "groups")
    labels = link_nodes(groups.select("node", "n", "signature", "text_key"), docs.select(F.col(text_col).cast("string").alias("text")))
    placed = groups.select("node", "low", "rows").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return signed.drop("signature"), stage(placed, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of ``docs``.

    Returns doc_id, n_shingles, component_id, kept for every row: component_id
    is the least doc_id reachable over links with Jaccard similarity of at
    least 0.75, kept says that it is the row's own.  Null and empty texts and
    texts without words have no shingles and stand alone; repeated rows fall
    into one class and each appears; rows that share a doc_id but not a text
    are separate rows; a row with a null doc_id links like any other, but null
    is no doc_id to be reached, so component_id is null only where no row of the
    class has one.  An empty table gives no rows.  Columns other than the two
    named are not read.
    """
    signed, placed = _classes(docs, id_col, text_col)
    ids = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = placed.join(ids, "component").select("node", "component_id", F.lit(True).alias("held"))
    return (
        signed.join(named, "node", "left")
        .withColumn("component_id", F.when(F.col("held"), F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class, as it is: that of the least doc_id, null ids last.

    Of rows that share this id and the words, any one stays.  Rows without
    words all stay, also where they are repeated.  Rows of classes of one row
    are passed on where they are; the others' keepers are shuffled.
    """
    signed, placed = _classes(docs, id_col, text_col)
    # of a class: rows in all, and the least (no id, id, set)
    order = F.struct(F.col("low").isNull().alias("no"), "low", "node")
    classes = placed.groupBy("component").agg(F.sum("rows").alias("rows"), F.min(order).alias("x")).where("rows > 1")
    crowded = placed.select("node", "component").join(classes, "component").select("node", F.col("x.node").alias("__of"), F.col("x.low").alias("__low"))
    texts = signed.where("n_shingles > 0").select("node", "text_key").distinct().join(crowded, "node")
    texts = stage(texts.select(F.col("text_key").alias("__key"), F.col("node").alias("__node"), "__of", "__low"), "crowded")
    bits = membership_filter(texts, "__key")

    @F.arrow_udf("boolean")
    def maybe(slots: pa.Array) -> pa.Array:
        return pa.array(in_filter(bits, slots.to_numpy(zero_copy_only=False)))

    marked = docs.withColumn("__key", text_key(text_col)).withColumn("__maybe", maybe(F.xxhash64("__key")))
    named = marked.where("__maybe").join(texts, "__key", "left")
    own = (F.col("__node") == F.col("__of")) & F.col(id_col).cast("long").eqNullSafe(F.col("__low"))
    keepers = named.where(F.col("__of").isNotNull() & own).dropDuplicates(["__node"])
    return marked.where("not __maybe").select(*docs.columns).unionByName(named.where("__of is null").select(*docs.columns)).unionByName(keepers.select(*docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL of ``near_duplicates`` over ``documents``: every pair that shares a shingle, and the closure of what is linked."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, '{letters}', '{letters.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')))) END AS s FROM words),
nodes AS MATERIALIZED (SELECT row_number() OVER () AS node, s, len(s) AS n, low FROM (SELECT s, min(doc_id) AS low FROM sets WHERE len(s) > 0 GROUP BY s)),
items AS MATERIALIZED (SELECT node, n, unnest(s) AS x FROM nodes),
links AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
reach AS (SELECT node AS u, node AS v FROM nodes UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
lows AS (SELECT u, min(low) AS component_id FROM reach JOIN nodes ON node = v GROUP BY u)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN node IS NULL THEN doc_id ELSE component_id END AS component_id, coalesce(doc_id = CASE WHEN node IS NULL THEN doc_id ELSE component_id END, false) AS kept
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN lows ON u = node"""
