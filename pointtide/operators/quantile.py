"""Exact order statistics per group, without any group having to fit one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import cut, join_null_safe

__all__ = ["grouped_ranks", "grouped_median"]

#: Buckets of more rows than this are counted in finer ones before their values are ranked; key tables up to BROADCAST_ROWS are broadcast.
LIGHT_ROWS = 200_000
BROADCAST_ROWS = 100_000
#: Buckets per factor of e, at first and in a bucket that holds too many rows.
COARSE, FINE = 64, 1 << 18


def _bucket(v, per: int):
    """A number that never falls as v grows, ``per`` values to every factor of e."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e9) * per)


def _holding(counts: DataFrame, group: list[str], at: str, ranks: Callable | None, before: str | None = None) -> DataFrame:
    """The buckets ``at`` that hold the two ranks of each group: their counts, and how many values come before them."""
    w = Window.partitionBy(*group)
    upto = F.sum("_n").over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if ranks is not None:
        total = F.sum("_n").over(w)
        placed = counts.select("*", upto.alias("_upto"), *[F.least(F.greatest(r.cast("bigint"), F.lit(0)), total - 1).alias(n) for r, n in zip(ranks(total), ("_lo", "_hi"))])
    else:
        placed = counts.withColumn("_upto", upto + F.col(before)).drop(before)
    holds = lambda r: (F.col("_upto") > F.col(r)) & (F.col("_upto") - F.col("_n") <= F.col(r))
    names = [c for c in counts.columns if c not in (before, "_lo", "_hi")]
    return placed.where(holds("_lo") | holds("_hi")).select(*names, (F.col("_upto") - F.col("_n")).alias("_before"), "_lo", "_hi")


def grouped_ranks(df: DataFrame, keys: list[str], values: list[str], ranks: Callable[[Column], tuple[Column, Column]], light_rows: int = LIGHT_ROWS, every: bool = True) -> DataFrame:
    """keys and, of each column v of ``values``, v_low and v_high: the exact values at two ranks (from 0) that ``ranks`` gives for the number
    of values, held within it. Nulls are left aside; a group without values has nulls, or no row without ``every``. Numbers must be
    finite. ``df`` is gone through two or three times; what is costly to work out should be kept.

    Values are counted per logarithmic bucket, which partial aggregation does before anything is shuffled; only the values of the
    buckets that hold the ranks travel and are ranked. A bucket of more than ``light_rows`` rows is first counted in finer ones."""
    long = df.select(*keys, F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_i", "_v"))
    counts = long.groupBy(*keys, "_i", _bucket(F.col("_v"), COARSE).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts) if every else counts
    mid = cut(_holding(counts.where("_b is not null"), [*keys, "_i"], "_b", ranks))
    groups, most = mid.agg(F.count(F.lit(1)), F.max("_n")).first()
    inside = join_null_safe(long.withColumn("_b", _bucket(F.col("_v"), COARSE)), mid.drop("_n"), [*keys, "_i", "_b"], broadcast=groups <= BROADCAST_ROWS)
    at, start = [*keys, "_i", "_b"], ["_before", "_lo", "_hi"]
    if (most or 0) > light_rows:
        inside = inside.withColumn("_c", _bucket(F.col("_v"), FINE)).persist()
        finer = inside.groupBy(*at, "_c", *start).agg(F.count(F.lit(1)).alias("_n"))
        finer = cut(_holding(finer, at, "_c", None, "_before").drop("_n"))
        inside = join_null_safe(inside.drop(*start), finer, [*at, "_c"], broadcast=finer.count() <= BROADCAST_ROWS)
        at = [*at, "_c"]
    ranked = inside.groupBy(*at, *start, "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*at).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    ranked = ranked.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    pick = lambda i, rank: F.max(F.when((F.col("_i") == i) & (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.col("_v")))
    found = ranked.groupBy(*keys).agg(*[pick(i, r).alias(f"{v}{n}") for i, v in enumerate(values) for r, n in (("_lo", "_low"), ("_hi", "_high"))])
    return join_null_safe(counts.select(*keys).distinct(), found, keys, "left") if every else found


def grouped_median(df: DataFrame, keys: list[str], values: list[str], light_rows: int = LIGHT_ROWS, every: bool = True) -> DataFrame:
    """keys and the exact median (the mean of the two middle values where their number is even) of each column of ``values``
    under its own name; nulls are left aside, a group without values has null, or no row without ``every``."""
    r = grouped_ranks(df, keys, values, lambda n: (F.floor((n - 1) / 2), F.floor(n / 2)), light_rows, every)
    return r.select(*keys, *[((F.col(f"{v}_low") + F.col(f"{v}_high")) / 2).alias(v) for v in values])
