"""Word and shingle hashes of whole texts, over bytes and without Python loops
per word.

A word is a maximal run of characters other than space and U+0009 to U+000D;
A to Z are lower-cased.  All separators are ASCII, so words can be found in
UTF-8 bytes directly.  A word's hash is the sum of a random 64-bit value per
byte times an odd number's power by position, taken from running sums over many
words at once and finalised; a shingle's hash mixes the hashes of its words.  Blocks are cut at separators, so memory is bounded by the
block and not by the text.
"""

from __future__ import annotations

import numpy as np

from spanloom.llm.common import mix64, seeds

#: Bytes that are hashed at a time, and up to the end of a word.
BLOCK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = seeds(256, 11)[_LOWER]
_LENGTH = seeds(64, 13)
_BASE = int(seeds(1, 15)[0] | np.uint64(5))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd number's powers modulo 2^64, and their inverses."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, 1 << 19)
    with np.errstate(over="ignore"):
        made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if size == 1 << 19:  # those of a very long word aren't kept
        _POWERS[:] = made
    return made[0], made[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets per text) for texts given as bytes and offsets."""
    n, at = len(data), 0
    hashes, starts_all = [], []
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        while end < n and not _SEPARATOR[data[end]]:  # to the end of the word
            step = np.flatnonzero(_SEPARATOR[data[end : end + 65536]])
            end = end + int(step[0]) if len(step) else min(n, end + 65536)
        block = data[at:end]
        inside = ~_SEPARATOR[block]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [at, end])
        cut = offsets[lo:hi] - at
        cut = cut[cut < len(block)]
        begins[cut] = inside[cut]  # a text's first byte begins a word
        starts = np.flatnonzero(begins)
        if len(starts):
            last = inside.copy()
            last[:-1] &= ~inside[1:] | begins[1:]
            power, inverse = _powers(len(block))
            sums = np.zeros(len(block) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(_BYTE[block] * power[: len(block)], out=sums[1:])
                hashes.append(mix64((sums[np.flatnonzero(last) + 1] - sums[starts]) * inverse[starts]))
            starts_all.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in order, shingle offsets per text).

    A text with fewer than ``size`` words but at least one has one shingle, its
    whole sequence; a text without words has none.
    """
    factors = seeds(size, 14) | np.uint64(1)
    counts = np.diff(offsets)
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    total = int(out_offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), out_offsets
    owner = np.repeat(np.arange(len(counts)), out_counts)
    first = offsets[owner] + (np.arange(total) - out_offsets[owner])
    length = np.minimum(counts[owner], size)
    with np.errstate(over="ignore"):
        acc = _LENGTH[length]
        last = len(words) - 1
        for k in range(size):
            part = words[np.minimum(first + k, last)] * factors[k]
            acc = acc + (part if k == 0 else np.where(length > k, part, np.uint64(0)))
    return mix64(acc), out_offsets


def sorted_sets(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order."""
    if not len(shingles):
        return shingles, offsets
    counts = np.diff(offsets)
    values = np.empty_like(shingles)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        values[a:b] = np.sort(shingles[a:b])
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[keep], minlength=len(counts))
    return values[keep], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
