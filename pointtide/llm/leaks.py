"""Evaluation texts leaking into a corpus (problem 8).

Winnowing: of every window of consecutive K-grams of words the least hash is kept as a fingerprint, so that every shared span of
SPAN words or more leaves a common one on both sides. Corpus fingerprints meet those of the evaluation items, and each meeting
is extended word by word in both directions; a span of at least SPAN equal words is a leak.

Words are the longest runs of letters and digits after compatibility decomposition, without combining marks, in lower case.

Defined results: null and short texts share nothing; repeated rows count once; whole texts are read, however long; an empty
table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import small_enough

__all__ = ["SPAN", "words", "fingerprints", "shares_span", "leaked"]

SPAN = 12
GRAM = 8
#: Evaluation items up to this number, and this many characters together, are sent to every worker; more are joined by fingerprint.
CARRIED_ITEMS, CARRIED_CHARS = 5_000, 20_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}
#: The index of the items that a worker was last sent, by their broadcast.
_held: dict[int, tuple] = {}


def words(text: str | None) -> list[str]:
    import regex

    if not text:
        return []
    if not text.isascii():
        text = regex.sub(r"\p{M}+", "", unicodedata.normalize("NFKD", text))
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) > 500_000:
            _known.clear()
        h = _known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return h


def fingerprints(w: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the fingerprints of a list of words, each position once."""
    window = span - gram + 1
    n = len(w) - gram + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.array([_hash(x) for x in w], np.uint64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            acc = acc * _BASE + h[i:i + n]
        acc ^= acc >> np.uint64(31)
        acc *= np.uint64(0x94D049BB133111EB)
        acc ^= acc >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(acc, window).argmin(1) + np.arange(n - window + 1)
    at = np.unique(least)
    return acc[at].view(np.int64), at


def shares_span(a: list[str], b: list[str], i: int, j: int, span: int = SPAN) -> bool:
    """Whether the equal words around a[i] and b[j] make a span of ``span`` or more."""
    lo = 0
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi = 0
    while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return lo + hi >= span


def _index(items: list[tuple[int, str]]):
    """Words of each item; fingerprints sorted, with item number and position."""
    texts = [words(t) for _, t in items]
    prints = [fingerprints(w) for w in texts]
    h = np.concatenate([p[0] for p in prints]) if prints else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(items)), [len(p[0]) for p in prints]) if prints else np.empty(0, np.int64)
    at = np.concatenate([p[1] for p in prints]) if prints else np.empty(0, np.int64)
    o = np.argsort(h, kind="stable")
    return texts, h[o], who[o], at[o]


def leaked(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, carried_items: int = CARRIED_ITEMS) -> DataFrame:
    """(key, item_key): the documents that share ``SPAN`` or more consecutive words with an item."""
    docs = corpus.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    held = items.select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    kinds = dict(docs.dtypes)["k"], dict(held.dtypes)["i"]
    if small_enough(held, carried_items) and (held.agg(F.sum(F.length("t"))).first()[0] or 0) <= CARRIED_CHARS:
        rows = held.toArrow()
        found = _carried(docs, list(zip(rows.column("i").to_pylist(), rows.column("t").to_pylist())), kinds)
    else:
        found = _joined(docs, held, kinds)
    return found.distinct().select(F.col("k").alias(key), F.col("i").alias(item_key))


def _carried(docs: DataFrame, items: list, kinds) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        items = sent.value
        if id(items) not in _held:
            _held.clear()
            _held[id(items)] = items, _index(items)
        texts, h, who, at = _held[id(items)][1]
        for b in batches:
            keys, found = [], []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                w = words(t)
                fh, fp = fingerprints(w)
                lo, hi = np.searchsorted(h, fh, side="left"), np.searchsorted(h, fh, side="right")
                done = set()
                for f in np.flatnonzero(hi > lo):
                    for e in range(lo[f], hi[f]):
                        if who[e] not in done and shares_span(w, texts[who[e]], int(fp[f]), int(at[e])):
                            done.add(who[e])
                keys += [k] * len(done)
                found += [items[e][0] for e in sorted(done)]
            yield pa.RecordBatch.from_pydict({"k": keys, "i": found}, schema=pa.schema([("k", b.schema.field("k").type), ("i", pa.int64() if kinds[1] in ("bigint", "int") else pa.string())]))

    return docs.mapInArrow(search, f"k {kinds[0]}, i {'bigint' if kinds[1] in ('bigint', 'int') else 'string'}")


def _prints(rows: DataFrame, key: str, kind: str) -> DataFrame:
    def take(batches):
        for b in batches:
            found = [np.unique(fingerprints(words(t))[0]) for t in b.column("t").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=[key, "h"])

    return rows.mapInArrow(take, f"{key} {kind}, h bigint")


def _joined(docs: DataFrame, held: DataFrame, kinds) -> DataFrame:
    """Both sides' fingerprints joined; each pair that meets is then verified on its texts."""
    pairs = _prints(docs, "k", kinds[0]).join(_prints(held, "i", kinds[1]), "h").select("k", "i").distinct()
    texts = pairs.join(docs, "k").join(held.withColumnRenamed("t", "u"), "i")

    def verify(batches):
        for b in batches:
            keep = []
            for t, u in zip(b.column("t").to_pylist(), b.column("u").to_pylist()):
                w, x = words(t), words(u)
                (fh, fp), (gh, gp) = fingerprints(w), fingerprints(x)
                at: dict[int, list[int]] = {}
                for h, p in zip(gh.tolist(), gp.tolist()):
                    at.setdefault(h, []).append(p)
                keep.append(any(shares_span(w, x, p, q) for h, p in zip(fh.tolist(), fp.tolist()) for q in at.get(h, ())))
            yield b.select(["k", "i"]).filter(pa.array(keep, pa.bool_()))

    return texts.select("k", "i", "t", "u").mapInArrow(verify, f"k {kinds[0]}, i {kinds[1]}")
