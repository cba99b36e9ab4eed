"""Encoding of a corpus with a public byte-level vocabulary (problem 7).

Texts are cut by the vocabulary's pattern; the different pieces of a batch are bucketed by length into padded matrices. In
every round each row merges its leftmost pair of the least rank, found by a hashed pair lookup, and closes the gap; rows without
a pair leave the matrix. Pieces above LONGEST bytes are merged one by one over a heap instead, with the same result.

Defined results: an empty or null text has no ids (an empty list); repeated rows (same key) count once; strings of special
tokens are ordinary text; whole texts are encoded, however long; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["PATTERN", "Vocabulary", "encode_corpus"]

#: Fixed value: the pattern that splits texts before the merges of byte-level vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 1024
NONE = np.int32(2**31 - 1)
#: Pieces remembered by a worker between batches.
REMEMBERED = 300_000


class Vocabulary:
    """Ranks of a file in the common base64 format, with a hash table of all pairs that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        self._table(np.array(keys, np.int64), np.array(merged, np.int32))
        self.seen: dict[str, np.ndarray] = {}

    @staticmethod
    def _hash(key: np.ndarray, bits: int) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(4 * max(len(keys), 1)))))
        self.mask = (1 << self.bits) - 1
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, NONE, np.int32)
        at, todo = self._hash(keys, self.bits), np.arange(len(keys))
        while len(todo):
            free = self.key[at[todo]] == -1
            first, where = np.unique(np.where(free, at[todo], -1 - np.arange(len(todo))), return_index=True)
            put = todo[where[first >= 0]]
            self.key[at[put]], self.to[at[put]] = keys[put], merged[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, NONE where it makes none."""
        shape = a.shape
        key = (a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF).ravel()
        at = self._hash(key, self.bits)
        out = np.full(key.shape, NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            there = self.key[at]
            hit = there == key[todo]
            out[todo[hit]] = self.to[at[hit]]
            go = ~hit & (there != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        rank[ids[:, 1:] < 0] = NONE
        rows, done = np.arange(n), [None] * n
        while True:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            over = least == NONE
            if over.any():
                for r in np.flatnonzero(over):
                    done[rows[r]] = ids[r, : size[rows[r]]].copy()
                go = ~over
                rows, ids, rank, best, least = rows[go], ids[go], rank[go], best[go], least[go]
            if not len(rows):
                return done
            k = np.arange(len(rows))
            ids[k, best] = least
            # close the gap behind the merged token
            cols = np.arange(ids.shape[1] - 1)
            src = cols + (cols > best[:, None])
            ids = np.take_along_axis(ids, src, 1)
            size[rows] -= 1
            cols = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
            width = int(size[rows].max())
            ids, rank = ids[:, :width], rank[:, : max(width - 1, 0)]
            # only the pairs beside the merged token are new
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < size[rows] - 1))
                rank[ok, side[ok]] = self.pair(ids[ok, side[ok]], ids[ok, side[ok] + 1])

    def _heap(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        ranks, cache = self, {}

        def rank(a, b):
            if (a, b) not in cache:
                cache[a, b] = int(ranks.pair(np.array([a]), np.array([b]))[0])
            return cache[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (z := rank(ids[x], ids[y])) != NONE:
                    heapq.heappush(heap, (z, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(texts)
        buckets: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            b = t.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(b) > LONGEST:
                out[k] = self._heap(b)
            else:
                w = 4 * -(-len(b) // 4) if len(b) <= 32 else 1 << (len(b) - 1).bit_length()
                buckets.setdefault(w, []).append(k)
        for w, at in buckets.items():
            step = max(1, 4_000_000 // w)
            for lo in range(0, len(at), step):
                part = at[lo:lo + step]
                for k, ids in zip(part, self._matrix([texts[k].encode() for k in part], w)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text)."""
        import regex

        find = regex.compile(PATTERN).findall
        number: dict[str, int] = {}
        at, ends = [], []
        for t in texts:
            if t:
                at += [number.setdefault(p, len(number)) for p in find(t)]
            ends.append(len(at))
        names = list(number)
        new = [p for p in names if p not in self.seen]
        fresh = dict(zip(new, self.pieces(new)))
        ids = [fresh[p] if p in fresh else self.seen[p] for p in names]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
        self.seen.update((p, i) for p, i in fresh.items() if len(p) <= 64)
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        start = np.cumsum(size) - size
        at = np.array(at, np.int64)
        n = size[at]
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(total[-1]) - np.repeat(total[:-1] - start[at], n)
        return flat[where], total[np.array(ends, np.int64)]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_corpus(df: DataFrame, key: str, text: str, path: str, rows: int = 2000) -> DataFrame:
    """(key, ids array<int>): the token ids of every document under the vocabulary file at ``path``, which every executor must be
    able to read."""
    one = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).groupBy("key").agg(F.min("text").alias("text"))

    def encode(batches):
        v = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                ids, ends = v.encode(part.column("text").to_pylist())
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    kind = dict(one.dtypes)["key"]
    return one.mapInArrow(encode, f"{key} {kind}, ids array<int>")
