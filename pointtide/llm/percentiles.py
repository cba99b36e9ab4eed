"""Percentiles of very large columns, with a stated rank error (problem 5).

A summary of a column keeps some of its values, each with the rank interval it is known to occupy: at most ``under`` values
are smaller and at least ``upto`` are not larger. Every partition summarises its rows batch by batch, compressing to the
permitted uncertainty; summaries merge by adding up the bounds, with a fixed fan-in per level, so that no task sees more than
FAN_IN of them for one group. Nothing is random, and the error stated with each percentile is what its bounds prove.

Defined results: missing and non-finite values are left aside; repeated rows (same key) count once; the p-th percentile is the
value of rank ceil(p n), at least 1; rows without a source, or without a time, form a source and a day of their own, which are
null; a group without values gives no rows; up to the number of kept values the result is exact, with error 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import finite, join_null_safe, small_enough

__all__ = ["Summary", "summaries", "merge_levels", "percentiles", "rank_check"]

FAN_IN = 64
#: Summaries of a group that wait in a partition until they are merged: a partition of m rows merges log(m) times, not m.
MERGED = 16
#: Summaries that one call of the merger takes, of whatever groups.
BIN_ROWS = 256
BROADCAST_ROWS = 100_000


class Summary:
    """v ascending and different; under[i]: at most so many values are below v[i]; upto[i]: at least so many are not above it."""

    __slots__ = ("v", "under", "upto", "n")

    def __init__(self, v, under, upto, n):
        self.v, self.under, self.upto, self.n = v, under, upto, int(n)

    @classmethod
    def of(cls, values: np.ndarray) -> "Summary":
        v, c = np.unique(values, return_counts=True)
        upto = np.cumsum(c)
        return cls(v, upto - c, upto, len(values))

    @staticmethod
    def merge(parts: list["Summary"]) -> "Summary":
        parts = [p for p in parts if p.n]
        if len(parts) == 1:
            return parts[0]
        v = np.unique(np.concatenate([p.v for p in parts])) if parts else np.empty(0)
        under, upto = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        for p in parts:
            under += np.append(p.under, p.n)[np.searchsorted(p.v, v, side="left")]
            upto += np.concatenate([[0], p.upto])[np.searchsorted(p.v, v, side="right")]
        return Summary(v, under, upto, sum(p.n for p in parts))

    def compress(self, keep: int) -> "Summary":
        """At most ``keep`` + 1 of the values, nearest to evenly spread ranks; the ends always stay."""
        if len(self.v) <= keep + 1:
            return self
        mid = (self.under + 1 + self.upto) / 2
        want = 1 + np.arange(keep + 1) * ((self.n - 1) / keep)
        at = np.clip(np.searchsorted(mid, want), 1, len(mid) - 1)
        at = np.where(want - mid[at - 1] <= mid[at] - want, at - 1, at)
        at = np.unique(np.concatenate([[0], at, [len(mid) - 1]]))
        return Summary(self.v[at], self.under[at], self.upto[at], self.n)

    def at(self, p: float) -> tuple[float, int]:
        """The p-th percentile, and by how many ranks it may be off."""
        r = min(max(1, int(np.ceil(p * self.n - 1e-9))), self.n)
        off = np.maximum(0, np.maximum(self.under + 1 - r, r - self.upto))
        i = int(np.argmin(off))
        return float(self.v[i]), int(off[i])


def _row(s: Summary) -> tuple:
    return s.v, s.under, s.upto, s.n


SCHEMA = "source bigint, day date, field int, node bigint, v array<double>, under array<bigint>, upto array<bigint>, n bigint"
_ARROW = pa.schema([
    ("source", pa.int64()), ("day", pa.date32()), ("field", pa.int32()), ("node", pa.int64()),
    ("v", pa.list_(pa.float64())), ("under", pa.list_(pa.int64())), ("upto", pa.list_(pa.int64())), ("n", pa.int64()),
])


def _table(rows: list[tuple]) -> pa.Table:
    """rows of (source, day, field, node, Summary); day in days or None."""
    def lists(k, t):
        parts = [getattr(r[4], k) for r in rows]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], t))

    return pa.Table.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()).cast(pa.date32()), pa.array([r[2] for r in rows], pa.int32()),
        pa.array([r[3] for r in rows], pa.int64()), lists("v", pa.float64()), lists("under", pa.int64()), lists("upto", pa.int64()), pa.array([r[4].n for r in rows], pa.int64()),
    ], schema=_ARROW)


def _read(t):
    """(source, day, field, node, Summary) of the rows of a table."""
    cols = [t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c) for c in ("v", "under", "upto")]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in cols]
    ends = np.concatenate([[0], np.cumsum(np.diff(cols[0].offsets.to_numpy()))])
    days = t.column("day").cast(pa.int32()).to_pylist()
    for i, (s, d, f, k, n) in enumerate(zip(t.column("source").to_pylist(), days, t.column("field").to_pylist(), t.column("node").to_pylist(), t.column("n").to_pylist())):
        a, b = ends[i], ends[i + 1]
        yield s, d, f, k, Summary(flat[0][a:b], flat[1][a:b], flat[2][a:b], n)


def summaries(rows: DataFrame, fields: list[str], keep: int) -> DataFrame:
    """One summary per partition, source, day and field of ``rows`` (source, day and the columns ``fields``)."""
    names = list(fields)

    def partition(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        waiting: dict = defaultdict(list)  # raw values of a group
        held: dict = defaultdict(list)  # its summaries, by how often they were merged
        counts: dict = defaultdict(int)

        def hold(key, s: Summary, level: int = 0) -> None:
            if level == len(held[key]):
                held[key].append([])
            same = held[key][level]
            same.append(s)
            if len(same) == MERGED:
                held[key][level] = []
                hold(key, Summary.merge(same).compress(4 * keep), level + 1)

        for b in batches:
            if not b.num_rows:
                continue
            none = b.column("source").is_null().to_numpy(zero_copy_only=False)
            src = b.column("source").fill_null(0).to_numpy(zero_copy_only=False)
            day = b.column("day").cast(pa.int32()).fill_null(-(1 << 30)).to_numpy(zero_copy_only=False)
            order = np.lexsort((day, src, none))
            src, day, none = src[order], day[order], none[order]
            first = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (day[1:] != day[:-1]) | (none[1:] != none[:-1])]))
            last = np.append(first[1:], len(src))
            for f, name in enumerate(names):
                x = b.column(name).to_numpy(zero_copy_only=False).astype(np.float64)[order]
                good = np.isfinite(x)
                for lo, hi in zip(first, last):
                    part = x[lo:hi][good[lo:hi]]
                    if not len(part):
                        continue
                    key = None if none[lo] else int(src[lo]), int(day[lo]), f
                    waiting[key].append(part)
                    counts[key] += len(part)
                    if counts[key] > 8 * keep:
                        hold(key, Summary.of(np.concatenate(waiting.pop(key))).compress(4 * keep))
                        counts[key] = 0
        out = []
        for key in set(waiting) | set(held):
            parts = ([Summary.of(np.concatenate(waiting[key]))] if waiting.get(key) else []) + [s for same in held.get(key, ()) for s in same]
            out.append((key[0], None if key[1] == -(1 << 30) else key[1], key[2], node, Summary.merge(parts).compress(keep)))
            if len(out) >= 2000:
                yield from _table(out).to_batches()
                out = []
        if out:
            yield from _table(out).to_batches()

    return rows.select("source", "day", *names).mapInArrow(partition, SCHEMA)


def _merger(keep: int):
    def merge(t: pa.Table) -> pa.Table:
        groups = defaultdict(list)
        for s, d, f, k, x in _read(t):
            groups[s, d, f, k].append(x)
        return _table([(*key, Summary.merge(parts).compress(keep)) for key, parts in groups.items()])

    return merge


def merge_levels(parts: DataFrame, keep: int) -> DataFrame:
    """One summary per source, day and field of ``parts``, which should be kept; each level merges up to FAN_IN nodes, until the nodes
    at hand have become one."""
    n, low, high = parts.agg(F.count(F.lit(1)), F.min("node"), F.max("node")).first()
    parts, width = parts.withColumn("node", F.col("node") - F.lit(low or 0)), (high or 0) - (low or 0) + 1
    while True:
        parts = parts.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("bigint"))
        width = -(-width // FAN_IN)
        bins = F.pmod(F.xxhash64("source", "day", "field", "node"), F.lit(n // BIN_ROWS + 16))
        parts = parts.groupBy(bins).applyInArrow(_merger(keep), SCHEMA)
        if width <= 1:
            return parts


def _rows(df: DataFrame, key: str, source: str, at: str, fields: dict) -> DataFrame:
    """(source, day, f0, f1, ...) once per key; numbers that are missing or not finite are null."""
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.col(source).cast("bigint").alias("source"), F.to_date(at).alias("day"),
        *[F.when(finite(c), c.cast("double")).alias(f"f{i}") for i, c in enumerate(fields.values())],
    )
    return rows.dropDuplicates(["key"]).drop("key")


def percentiles(df: DataFrame, key: str, source: str, at: str, fields: dict, ps: list[float], keep: int = 1000) -> DataFrame:
    """(level, source, day, field, n, p, value, rank_error): percentiles ``ps`` of every column of ``fields`` (name -> Column), at level
    "day" per source and day, and at level "all" per source over all its days (day is null). ``keep`` values a summary: each
    compression adds at most n / keep / 2 ranks to the error, and there are two or three of them, so that rank_error stays below
    2 n / keep."""
    names = list(fields)
    cols = [f"f{i}" for i in range(len(names))]
    one = _rows(df, key, source, at, fields).select("source", "day", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in cols])
    days = merge_levels(summaries(one, cols, keep).persist(), keep).persist()
    # the days of a source merge as nodes of one group
    number = F.coalesce(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(0)).cast("bigint")
    spans = days.withColumn("node", number).withColumn("day", F.lit(None).cast("date"))
    both = days.withColumn("level", F.lit("day")).union(merge_levels(spans, keep).withColumn("level", F.lit("all")))

    def report(batches):
        for b in batches:
            levels = b.column("level").to_pylist()
            out = [(g, s, d, names[f], x.n, p, *x.at(p)) for g, (s, d, f, _, x) in zip(levels, _read(b)) if x.n for p in ps]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()).cast(pa.date32()), pa.array(c[3]), pa.array(c[4], pa.int64()), pa.array(c[5], pa.float64()), pa.array(c[6], pa.float64()), pa.array(c[7], pa.int64())],
                    names=["level", source, "day", "field", "n", "p", "value", "rank_error"],
                )

    return both.mapInArrow(report, f"level string, {source} bigint, day date, field string, n bigint, p double, value double, rank_error bigint")


def rank_check(df: DataFrame, found: DataFrame, key: str, source: str, at: str, fields: dict, ps: list[float], keep: int) -> DataFrame:
    """(level, source, day, field, n, p, within, bounded) of what ``percentiles`` found with ``keep`` values: whether the value's true rank,
    counted over all rows, is within rank_error of the one asked for, and rank_error below 2 n / keep."""
    names = list(fields)
    asked = found.groupBy("level", F.col(source).alias("source"), "day", "field").agg(
        F.first("n").alias("n"), *[F.max(F.when(F.col("p") == p, F.struct("value", "rank_error"))).alias(f"a{i}") for i, p in enumerate(ps)]
    ).persist()
    values = _rows(df, key, source, at, fields).select("source", "day", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"f{i}").alias("v")) for i, n in enumerate(names)])).alias("x"))
    values = values.select("source", F.explode(F.array(F.struct(F.lit("day").alias("level"), "day"), F.struct(F.lit("all").alias("level"), F.lit(None).cast("date").alias("day")))).alias("g"), "x.field", "x.v").select("g.level", "source", "g.day", "field", "v").where("v is not null")
    keys = ["level", "source", "day", "field"]
    met = join_null_safe(values, asked, keys, broadcast=small_enough(asked, BROADCAST_ROWS))
    counts = [c for i in range(len(ps)) for c in (F.sum((F.col("v") < F.col(f"a{i}.value")).cast("bigint")).alias(f"below{i}"), F.sum((F.col("v") <= F.col(f"a{i}.value")).cast("bigint")).alias(f"upto{i}"))]
    ranked = met.groupBy(*keys, "n", *[f"a{i}" for i in range(len(ps))]).agg(F.count(F.lit(1)).alias("m"), *counts)
    rows = []
    for i, p in enumerate(ps):
        want = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9))
        off = F.greatest(F.lit(0), F.col(f"below{i}") + 1 - want, want - F.col(f"upto{i}"))
        error = F.col(f"a{i}.rank_error")
        rows.append(F.struct(F.lit(p).alias("p"), ((off <= error) & (F.col("m") == F.col("n"))).alias("within"), (error * keep <= 2 * F.col("n")).alias("bounded")))
    return ranked.select("level", F.col("source").alias(source), "day", "field", "n", F.explode(F.array(*rows)).alias("r")).select("level", source, "day", "field", "n", "r.p", "r.within", "r.bounded")
