"""Ranks, budgets, samples and orders that no single task has to sort a whole table for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import mix_u32, morton3, quantise
from ..util import cut, join_null_safe, small_enough
from .quantile import grouped_ranks

__all__ = ["prune_budget", "systematic_sample", "density_thin", "zorder_rank", "transmittance", "trimmed_bounds", "trim_box", "truncated_percentile", "depth_bins", "depth_order"]

BROADCAST_ROWS = 100_000


def prune_budget(df: DataFrame, groups: list[str], score: Column, key: str, percent: float, protect_above: float) -> DataFrame:
    """``df`` without the rows of least score per group: at most floor(percent of the rows), of those with a score from 0 to below
    ``protect_above``; ties go by key. Only candidates are ranked."""
    total = df.groupBy(*groups).agg(F.floor(F.count(F.lit(1)) * (max(0.0, min(100.0, percent)) / 100.0)).alias("_budget"))
    cand = df.select(*groups, F.col(key).alias("_key"), score.alias("_score")).where((F.col("_score") >= 0) & (F.col("_score") < protect_above))
    ranked = cand.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("_score", "_key"))).join(total, groups)
    gone = ranked.where(F.col("_n") <= F.col("_budget")).select(F.col("_key").alias(key))
    return df.join(gone, key, "left_anti")


def systematic_sample(df: DataFrame, groups: list[str], order: str, limit: int) -> DataFrame:
    """Of each group the rows at positions floor(i * N / limit), i below limit; all rows of smaller groups."""
    w = Window.partitionBy(*groups)
    r = df.withColumn("_n", F.row_number().over(w.orderBy(order)) - 1).withColumn("_all", F.count(F.lit(1)).over(w))
    # row n is taken if some i has floor(i * N / limit) = n: the least such i is ceil(n * limit / N)
    i = F.floor((F.col("_n") * limit + F.col("_all") - 1) / F.col("_all"))
    taken = (i < limit) & (F.floor(i * F.col("_all") / limit) == F.col("_n"))
    return r.where((F.col("_all") <= limit) | taken).drop("_n", "_all")


def density_thin(df: DataFrame, record: str, density: float, opacity: str = "o") -> DataFrame:
    """The rows whose hashed record number falls below the density, with opacities raised to make up for the others."""
    if density >= 1:
        return df
    kept = df.where(mix_u32(F.col(record)) < int(density * 4294967296))
    return kept.withColumn(opacity, F.lit(1.0) - F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - F.col(opacity)), F.lit(1.0 / density)))


def zorder_rank(df: DataFrame, groups: list[str], key: str, bits: int = 10) -> DataFrame:
    """(groups, key, morton, rank): Morton number of the position within the group's bounds, and the rank along that curve."""
    bounds = df.groupBy(*groups).agg(*[f(a).alias(f"_{a}{n}") for a in "xyz" for f, n in ((F.min, 0), (F.max, 1))])
    q = [quantise(F.col(a), F.col(f"_{a}0"), F.col(f"_{a}1"), bits) for a in "xyz"]
    m = df.select(*groups, key, "x", "y", "z").join(bounds, groups).select(*groups, key, morton3(*q).alias("morton"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("morton", key)).cast("bigint"))


def transmittance(df: DataFrame, groups: list[str], depth: str, key: str, alpha: Column) -> DataFrame:
    """``df`` with transmittance: what the rows in front, by depth, let through of each group's ray, and weight, alpha times that.
    Products are sums of logarithms; a row of full opacity lets nothing through."""
    w = Window.partitionBy(*groups).orderBy(depth, key).rowsBetween(Window.unboundedPreceding, -1)
    a = df.withColumn("_a", F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)))
    solid = F.coalesce(F.max((F.col("_a") >= 1).cast("int")).over(w), F.lit(0))
    logs = F.coalesce(F.sum(F.when(F.col("_a") < 1, F.ln(F.lit(1.0) - F.col("_a")))).over(w), F.lit(0.0))
    t = F.when(solid == 1, F.lit(0.0)).otherwise(F.exp(logs))
    return a.withColumn("transmittance", t).withColumn("weight", F.col("_a") * F.col("transmittance")).drop("_a")


def trimmed_bounds(df: DataFrame, groups: list[str], value: str, trim: float) -> DataFrame:
    """(groups, low, high): the values at positions floor(n * trim) from either end."""
    return _bounds(df, groups, (value,), trim).select(*groups, F.col(f"{value}_low").alias("low"), F.col(f"{value}_high").alias("high"))


def _bounds(df: DataFrame, groups: list[str], values: tuple[str, ...], trim: float) -> DataFrame:
    off = lambda n: F.floor(n * trim)
    return grouped_ranks(df, groups, list(values), lambda n: (off(n), n - 1 - off(n)), every=False)


def trim_box(df: DataFrame, groups: list[str], axes: tuple[str, ...] = ("x", "y", "z"), trim: float = 0.005) -> DataFrame:
    """``df`` with low_a and high_a of every axis a, without the rows outside the trimmed bounds of any of them."""
    t = cut(_bounds(df, groups, axes, trim).select(*groups, *[F.col(f"{a}_{n}").alias(f"{n}_{a}") for a in axes for n in ("low", "high")]))
    df = join_null_safe(df, t, groups, broadcast=small_enough(t, BROADCAST_ROWS))
    for a in axes:
        df = df.where(F.col(a).between(F.col(f"low_{a}"), F.col(f"high_{a}")))
    return df


def truncated_percentile(df: DataFrame, groups: list[str], value: str, p: float) -> DataFrame:
    """(groups, value): the element at min(n - 1, floor(n * p)) of the sorted values, without interpolation."""
    at = lambda n: F.least(n - 1, F.floor(n * p))
    r = grouped_ranks(df, groups, [value], lambda n: (at(n), at(n)), every=False)
    return r.where(F.col(f"{value}_low").isNotNull()).select(*groups, F.col(f"{value}_low").cast(dict(df.dtypes)[value]).alias(value))


def depth_bins(df: DataFrame, groups: list[str], depth: str, bins: int = 65536) -> DataFrame:
    """(groups, bin, records, before): histogram of a depth over evenly spaced bins between its extremes, with the number of
    records in the bins before; with it each record's place in a counting sort is known without sorting records."""
    edge = df.groupBy(*groups).agg(F.min(depth).alias("_lo"), F.max(depth).alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(depth) - F.col("_lo")) * (F.lit(float(bins - 1)) / (F.col("_hi") - F.col("_lo"))))).otherwise(F.lit(0))
    n = df.join(edge, groups).groupBy(*groups, b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    w = Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("before", F.coalesce(F.sum("records").over(w), F.lit(0)))


def depth_order(df: DataFrame, groups: list[str], depth: str, key: str, bins: int = 65536) -> DataFrame:
    """(groups, key, bin, front, back): each record's place from front to back by its depth, and from back to front by a counting
    sort over evenly spaced bins, numbered from the far end, in which records of one bin stay in the order of their keys. Places start
    at 0."""
    edge = df.groupBy(*groups).agg(F.min(depth).alias("_lo"), F.max(depth).alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_hi") - F.col("_z")) * (F.lit(float(bins - 1)) / (F.col("_hi") - F.col("_lo"))))).otherwise(F.lit(0)).cast("bigint")
    r = df.select(*groups, key, F.col(depth).alias("_z")).join(edge, groups).select(*groups, key, "_z", b.alias("bin"))
    # a record's place is the number in the bins behind, and its place within its bin
    n = r.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("_n"))
    behind = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*groups, "bin", behind.alias("_behind"))
    r = r.withColumn("_in", F.row_number().over(Window.partitionBy(*groups, "bin").orderBy(key)) - 1).join(n, [*groups, "bin"])
    front = F.row_number().over(Window.partitionBy(*groups).orderBy("_z", key)) - 1
    return r.select(*groups, key, "bin", front.cast("bigint").alias("front"), (F.col("_behind") + F.col("_in")).cast("bigint").alias("back"))
