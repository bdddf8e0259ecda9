"""Supervised quality classifier over learned subword embeddings.

A text's features are its words, its pairs of neighbouring words (a word that
follows itself counts as the same pair whatever the word), and the character
n-grams (3 to 5) of each word with its bounds, hashed into buckets.  Every bucket
has a learned vector; a text's vector is the mean over all its features, and a
softmax over a linear map of it gives the score.  Vectors and map are trained
together by stochastic gradient descent in numpy, in one task.

The training set is a bounded sample of the labelled rows (SAMPLE rows, dealt by
a hash of the id), so fitting costs the same at every size; a text is dropped as
soon as it is a bag of at most BUCKETS counts.  Scoring covers every whole text:
the softmax of a mean is linear up to the last step, so each bucket's vector is
reduced to one number beforehand, and a text's score needs one gather and one
sum per feature.  Long texts are taken in pieces of at most PIECE characters, cut
at white space where there is any; no feature spans a cut, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, mix64, runs, ship, utf8

#: Labelled rows to learn from, at most; fewer are all taken.
SAMPLE = 5000
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4, 5)
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.5, 7
_P = np.uint64(0x9E3779B97F4A7C15)
#: All pairs of a word with itself are one feature.
_SAME = np.uint64(0xA5A5 << 48)
_BASE = 0x2545F4914F6CDD1D
#: Characters that are held as arrays at a time; they take about 60 bytes each.
PIECE = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def kinds(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """The words, the pairs, then the n-grams of each length: (buckets, which of them count, offsets per text)."""
    joined = " " + " ".join(texts) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    code = chars.astype(np.uint64)
    code[space] = 32
    # A gram belongs to the text that its second character is in.
    firsts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    firsts = np.concatenate([[0], firsts])
    with np.errstate(over="ignore"):
        begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
        stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
        power, inverse = _powers(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(code * power[: len(chars)], out=sums[1:])
        word = mix64((sums[stops] - sums[begins]) * inverse[begins])
        at = np.searchsorted(begins, firsts + 1)
        yield (word >> np.uint64(48)).astype(np.uint16), None, at
        pair = np.zeros(len(word), np.uint64)
        pair[1:] = mix64(word[:-1] * _P + word[1:])
        pair[1:][word[1:] == word[:-1]] = _SAME
        paired = np.ones(len(word), bool)
        paired[at[:-1][at[:-1] < len(word)]] = False  # a text's first word has none before it
        yield (pair >> np.uint64(48)).astype(np.uint16), paired, at
        h, held = code[:-1] * _P + code[1:], np.zeros(max(0, len(chars) - 1), bool)
        for n in range(3, max(GRAMS) + 1):
            m = len(chars) - n + 1
            if m <= 0:
                return
            held = held[:m] | space[n - 2 : n - 2 + m]
            h = h[:m] * _P + code[n - 1 :]
            if n in GRAMS:
                yield ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16), ~held, np.minimum(firsts, m)


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(which text, piece) of texts cut into pieces of at most PIECE characters, as many at a time as have about so many."""
    owner, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                space = max(text.rfind(c, at, end) for c in " \n\t")
                end = space if space > at else end
            owner.append(i), held.append(text[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield owner, held
                owner, held, size = [], [], 0
    if held:
        yield owner, held


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text, in order, and how often each occurs."""
    counts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    for owner, held in pieces(texts):
        parts: list[list[np.ndarray]] = [[] for _ in held]
        for bucket, used, at in kinds(held):
            for own, x, y in zip(parts, at[:-1].tolist(), at[1:].tolist(), strict=True):
                own.append(bucket[x:y] if used is None else bucket[x:y][used[x:y]])
        for i, own in zip(owner, parts, strict=True):
            ids, n = np.unique(np.concatenate(own), return_counts=True) if own else counts[i]
            if len(counts[i][0]) and own:
                ids, back = np.unique(np.concatenate([counts[i][0], ids]), return_inverse=True)
                n = np.bincount(back, np.concatenate([counts[i][1], n]), len(ids)).astype(np.int64)
            counts[i] = ids.astype(np.int64), n
    return counts


@dataclass
class Model:
    """bucket: each bucket's share of the difference of the two outputs; bias: the outputs' own."""

    bucket: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1; a text without features has that of the bias."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, held in pieces(texts):
            for bucket, counts, at in kinds(held):
                share = self.bucket[bucket]
                if counts is not None:
                    share *= counts
                    seen = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                    np.add.at(n, owner, seen[at[1:]] - seen[at[:-1]])
                else:
                    np.add.at(n, owner, np.diff(at))
                sums = np.concatenate([[0.0], np.cumsum(share, dtype=np.float64)])
                np.add.at(total, owner, sums[at[1:]] - sums[at[:-1]])
        return 1 / (1 + np.exp(-np.clip(np.where(n > 0, total / np.maximum(n, 1), 0) + self.bias, -500, 500)))


Bag = tuple[np.ndarray, np.ndarray]


def bags(texts: list[str]) -> list[Bag]:
    """The buckets of each text and their shares."""
    return [(ids.astype(np.uint16), (n / max(1, n.sum())).astype(np.float32)) for ids, n in features(texts)]


def fit(texts: list[Bag], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Train on bags of texts with labels 0 and 1.  Without both labels the score is the labels' mean, or 0.5."""
    labels = np.asarray(labels, np.int64)
    if len(np.unique(labels)) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, 2), np.float32)
    share = labels.mean()
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, step = epochs * -(-len(texts) // BATCH), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH)):
            lr = rate * (1 - step / steps)
            step += 1
            full = [r for r in rows if len(texts[r][0])]
            if not full:
                continue
            ids = np.concatenate([texts[r][0] for r in full]).astype(np.int64)
            weights = np.concatenate([texts[r][1] for r in full])
            sizes = np.array([len(texts[r][0]) for r in full])
            starts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(vectors[ids] * weights[:, None], starts)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(full)), labels[full]] -= 1  # the loss's slope by the outputs
            back = p @ out.T
            out -= lr * hidden.T @ p
            bias -= lr * p.mean(0)
            # Shares of a text are tiny: the step is such that the text's own mean moves by lr times its slope.
            norm = np.add.reduceat(weights * weights, starts)
            spread = np.repeat(back / norm[:, None] / len(full), sizes, axis=0) * weights[:, None]
            for k in range(WIDTH):
                vectors[:, k] -= lr * np.bincount(ids, spread[:, k], BUCKETS).astype(np.float32)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


@lean
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for at, end in runs(utf8(batch.column(1))[1], PIECE):
            part = batch.slice(at, end - at)
            texts = [x or "" for x in part.column(1).to_pylist()]
            rows += zip(part.column(0).to_pylist(), map(crc32, (t.encode("utf-8", "replace") for t in texts)), part.column(2).to_pylist(), bags(texts), strict=True)
    rows.sort(key=lambda r: r[:3])
    model = fit([r[3] for r in rows], np.array([r[2] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([model.bucket.tobytes()]), pa.array([model.bias])], names=["bucket", "bias"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` rows of ``docs`` that ``labels`` (doc_id, label) names.

    A doc_id that is labelled more than once has the label that most of its
    rows have, 1 if they are as many; null labels and ids are passed over.  Of
    ``docs`` only doc_id and text
    are read; of rows with one id the least text counts.  One task learns from the sample and returns the model: BUCKETS
    numbers and the bias.
    """
    ship(docs.sparkSession)
    marked = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    share = sample / max(1, marked.count())
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about SAMPLE ids and labels of 12 bytes are broadcast, and their texts go to one task.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").repartition(1)
    made = rows.mapInArrow(_fit, "bucket binary, bias double").first()
    return fit([], np.zeros(0)) if made is None else Model(np.frombuffer(made["bucket"], np.float32), made["bias"])


def _scores(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray]]:
    for a, b in runs(utf8(column)[1], 1 << 19):
        yield a, b, model.score([x or "" for x in column.slice(a, b - a).to_pylist()])


@lean
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, scores in _scores(batch.column(1), model):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores)], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, repeated ones and such with a null id as well; null and empty texts have the bias's score.

    An empty table gives no rows; columns other than doc_id and text are not read.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_score, model=model), "doc_id long, score double")


@lean
def _keep(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, scores in _scores(batch.column(text_at), model):
            yield batch.slice(a, b - a).filter(pa.array(scores >= least))


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores ``least`` or more; nothing is shuffled.

    Null and empty texts have the bias's score; repeated rows have one fate.
    """
    ship(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, model=model, text_at=docs.columns.index(text_col), least=least), docs.schema)


def held_out(column: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0
