"""Byte-level BPE ids of whole texts, equal to the tokenizer file's own.

The file's pre-tokenizer splits a text into letters, numbers, other characters
and white space; a split's ids do not depend on what surrounds it.  Splits are
found for a whole batch at once with array operations, hashed, and looked up in
a cache of ids; only splits that a worker has not seen go through the merges.
Texts with characters past U+024F, or with one of the file's special tokens,
go through the tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from spanloom.llm.common import mix64, seeds

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_LIMIT = 0x250
#: Splits that a worker keeps; beyond that it starts again. About 150 bytes each.
CACHE = 400_000


def _classes() -> np.ndarray:
    out = np.full(_LIMIT, _OTHER, np.uint8)
    for c in range(_LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[32, 0x85, 0xA0, *range(9, 14)]] = _SPACE
    return out


_CLASS = _classes()
_VALUE = seeds(_LIMIT, 31)
_BASE = int(seeds(1, 32)[0] | np.uint64(5))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd number's powers modulo 2^64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def split_starts(chars: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where each split begins, for code points of texts laid end to end.

    ``firsts`` are the places of the texts' first code points.  The rules are
    those of the byte-level pre-tokenizer: contractions, a space kept with the
    run that follows it, and a run of white space that leaves its last
    character to what comes next.
    """
    n = len(chars)
    kind = _CLASS[chars]
    first = np.zeros(n, bool)
    first[firsts] = True
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    spaced = np.zeros(n, bool)  # the character before is a plain space
    spaced[1:] = (chars[:-1] == 32) & ~first[1:]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 255, kind[1:]
    after[last] = 255
    space = kind == _SPACE
    starts = ~space & (kind != before) & ~spaced
    starts |= space & ((before != _SPACE) | ((after != _SPACE) & (after != 255)))
    quotes = np.flatnonzero((chars == 39) & (before != _OTHER) & ~spaced)
    if len(quotes):
        room = np.searchsorted(firsts, quotes, side="right")
        ends = np.append(firsts[1:], n)[room - 1]
        one = chars[np.minimum(quotes + 1, n - 1)]
        two = chars[np.minimum(quotes + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (quotes + 1 < ends)
        long = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & (quotes + 2 < ends)
        for hit, size in ((short, 2), (long & ~short, 3)):
            q = quotes[hit]
            starts[q] = True
            for inner in range(1, size):
                starts[q + inner] = False
            rest = q + size
            rest, at_end = rest[rest < n], None
            starts[rest[~space[rest]]] = True
    starts[firsts] = True
    return np.flatnonzero(starts)


class Ids:
    """The ids of a tokenizer file's byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        import tiktoken

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.merge = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.main = pd.Index(np.zeros(0, np.uint64))  # rows 0 to len(main) - 1 of at and size
        self.late: dict[int, int] = {}  # the rows since
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for one that isn't known."""
        rows = self.main.get_indexer(hashes) if len(self.main) else np.full(len(hashes), -1)
        missed = np.flatnonzero(rows < 0)
        if self.late and len(missed):
            get = self.late.get
            rows[missed] = [get(h, -1) for h in hashes[missed].tolist()]
        return rows

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = list(map(self.merge, pieces))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n, at = len(self.at), len(self.pool) + np.cumsum(size) - size
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.late.update(zip(hashes.tolist(), range(n, n + len(ids)), strict=True))
        if len(self.late) > max(20_000, len(self.main) // 2):
            self.main = self.main.append(pd.Index(np.fromiter(self.late, np.uint64, len(self.late))))
            self.late = {}

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens around them."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(lengths)
        odd = set(np.searchsorted(ends, np.flatnonzero(chars >= _LIMIT), side="right").tolist())
        if any(s in joined for s in self.special):
            odd.update(i for i, t in enumerate(texts) if any(s in t for s in self.special))
        if odd:
            out = [np.zeros(0, np.int32)] * len(texts)
            plain = [i for i in range(len(texts)) if i not in odd]
            for i in odd:
                out[i] = np.asarray(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
            for i, ids in zip(plain, self.batch([texts[i] for i in plain]) if plain else [], strict=True):
                out[i] = ids
            return out
        if not len(chars):
            return [np.zeros(0, np.int32)] * len(texts)
        if len(self.at) > CACHE:
            self.clear()
        full = np.flatnonzero(lengths)
        starts = split_starts(chars, (ends - lengths)[full])
        bounds = np.append(starts, len(chars))
        power, inverse = _powers(len(chars))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum(_VALUE[chars] * power[: len(chars)], out=sums[1:])
            hashes = mix64(np.diff(sums[bounds]) * inverse[starts])
        codes, unique = pd.factorize(hashes)
        rows = self._rows(unique)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = np.arange(len(self.at), len(self.at) + len(new))
            place = np.empty(len(unique), np.int64)
            place[codes[::-1]] = np.arange(len(codes))[::-1]
            place = place[new]
            self._add(unique[new], [joined[a:b].encode() for a, b in zip(starts[place].tolist(), bounds[place + 1].tolist(), strict=True)])
        row = rows[codes]
        size = self.size[row]
        after = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[row] - (after - size), size) + np.arange(int(after[-1]))]
        cuts = np.concatenate([[0], after])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One per worker process and file."""
    return Ids(path)
