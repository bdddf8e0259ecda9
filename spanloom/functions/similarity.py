"""Pair similarities.

Set and length measures are built in.  The two string ratios have no built-in
counterpart and run as Arrow functions, with numpy over all distinct pairs of a batch.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: From this length on the standard library's matcher leaves frequent characters out, so these pairs are left to it.
LONG = 200
#: So many pairs are compared at a time.
PAIRS = 2048


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of numbers from 1 for the characters of each text, filled up with 0; lengths)."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(int(points.max(initial=0)) + 1, np.uint32)
    number[points] = 1
    number = np.cumsum(number)
    code = np.zeros((len(texts), int(n.max(initial=0))), np.uint8 if number[-1] < 255 else np.uint32)
    code[np.arange(code.shape[1]) < n[:, None]] = number[points]
    return code, n


def _common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``common_subsequence`` of rows i of ``a`` and j of ``b``, 64 characters of ``a`` to a word, a character of all ``b`` at a time."""
    words = (a.shape[1] + 63) // 64
    at = np.zeros((len(a), int(max(a.max(initial=0), b.max(initial=0))) + 1, words), np.uint64)
    k, p = np.nonzero(a)
    np.bitwise_or.at(at, (k, a[k, p], p // 64), np.uint64(1) << (p % 64).astype(np.uint64))
    out = np.empty(len(i), np.int64)
    for low in range(0, len(i), PAIRS):
        mine, theirs = i[low : low + PAIRS], b[j[low : low + PAIRS]].T
        row = np.full((words, len(mine)), ~np.uint64(0))
        for c in theirs[: int((theirs != 0).sum(axis=0).max())]:
            hits, carry = at[mine, c].T, np.zeros(len(mine), np.uint64)
            for w in range(words):
                hit = row[w] & hits[w]
                total = row[w] + hit
                more = total < hit
                total += carry
                carry = (more | (total < carry)).astype(np.uint64)
                row[w] = total | (row[w] ^ hit)
        out[low : low + PAIRS] = 64 * words - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
    return out


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in a, start in b) of the longest common block of each column of two arrays, the first in a and then in b."""
    size, start, other = (np.zeros(a.shape[1], np.int64) for _ in range(3))
    best = np.zeros(a.shape[1], np.uint8)
    run, before = np.zeros((2, b.shape[0] + 1, a.shape[1]), np.uint8)  # the first row stays 0
    equal = np.empty(b.shape, bool)
    for r in range(len(a)):
        run, before = before, run
        np.equal(b, a[r], out=equal)
        np.add(before[:-1], 1, out=run[1:])
        np.multiply(run[1:], equal.view(np.uint8), out=run[1:])
        top = run.max(axis=0)
        better = np.flatnonzero(top > best)
        if len(better):
            best[better] = size[better] = top[better]
            start[better] = r + 1 - size[better]
            other[better] = run[:, better].argmax(axis=0) - size[better]
    return size, start, other


def _blocks(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of rows i of ``a`` and j of ``b``: the longest, then those left and right of it, for many pairs at a time."""
    out = np.zeros(len(i), np.int64)
    last = np.iinfo(a.dtype).max
    todo = np.stack([np.arange(len(i)), np.zeros(len(i), np.int64), n[i], np.zeros(len(i), np.int64), m[j]])
    while todo.shape[1]:
        todo = todo[:, np.lexsort((todo[4] - todo[3], todo[2] - todo[1]))]
        after = []
        for low in range(0, todo.shape[1], PAIRS):
            pair, a0, a1, b0, b1 = part = todo[:, low : low + PAIRS]
            across, down = np.arange((a1 - a0).max())[:, None], np.arange((b1 - b0).max())[:, None]
            x = a.ravel().take(i[pair] * a.shape[1] + a0 + across, mode="clip")
            y = b.ravel().take(j[pair] * b.shape[1] + b0 + down, mode="clip")
            np.putmask(x, across >= a1 - a0, 0)
            np.putmask(y, down >= b1 - b0, last)
            size, p, q = _longest(x, y)
            found = size > 0
            pair, a0, a1, b0, b1, size, p, q = (v[found] for v in (*part, size, p, q))
            np.add.at(out, pair, size)
            p, q = a0 + p, b0 + q
            after += [np.stack([pair, a0, p, b0, q]), np.stack([pair, p + size, a1, q + size, b1])]
        todo = np.concatenate(after, axis=1) if after else todo[:, :0]
        todo = todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]
    return out


def _indel(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    code, n = _coded(a + b)
    n, m = n[: len(a)][i], n[len(a) :][j]
    common = _common(code[: len(a)], code[len(a) :], i, j)
    return np.where((n > 0) & (m > 0), 2.0 * common / np.maximum(n + m, 1), 0.0)


def _matcher(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    code, n = _coded(a + b)
    n, m = n[: len(a)], n[len(a) :]
    total = n[i] + m[j]
    return np.where(total > 0, 2.0 * _blocks(code[: len(a)], code[len(a) :], i, j, n, m) / np.maximum(total, 1), 1.0)


def _batch(many, one, a: pa.Array, b: pa.Array) -> pa.Array:
    """A measure of each distinct pair: by ``many`` at a time, pairs with a text of LONG characters by ``one``."""
    a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
    a, b = (pc.dictionary_encode(pc.fill_null(x, "")) for x in (a, b))
    mine, theirs = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    pairs, back = np.unique(a.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(theirs)) + b.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    i, j = np.divmod(pairs, max(1, len(theirs)))
    long = np.fromiter((len(x) >= LONG for x in mine), bool, len(mine))[i] | np.fromiter((len(x) >= LONG for x in theirs), bool, len(theirs))[j]
    out = np.empty(len(pairs))
    short = np.flatnonzero(~long)
    if len(short):
        some = lambda texts: [x if len(x) < LONG else "" for x in texts]
        out[short] = many(some(mine), some(theirs), i[short], j[short])
    for k in np.flatnonzero(long):
        out[k] = one(mine[i[k]], theirs[j[k]])
    return pa.array(out[back], pa.float64())


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """2 * LCS / (length + length); 0 if either is blank."""
    return _batch(_indel, _ratio, a, b)


@F.arrow_udf(DoubleType())
def matcher_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of the standard library."""
    return _batch(_matcher, lambda x, y: SequenceMatcher(None, x, y).ratio(), a, b)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays that have no element twice."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i))))


def suffix_length(a: Column, b: Column) -> Column:
    return prefix_length(F.reverse(a), F.reverse(b))
