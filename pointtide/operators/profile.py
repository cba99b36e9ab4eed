"""Costs, dictionaries, palettes and other summaries of a capture."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["costs", "compact_dictionary", "normalised_frequencies", "ordered_digest", "cheapest", "pareto_choice", "size_estimate", "palette", "compare_fit", "weighted_kmeans"]


def costs(df: DataFrame, a: str, b: str, size: str) -> DataFrame:
    """(a, b, bytes, rows, share): totals per pair, per a, per b and over all, as grouping sets."""
    total = df.agg(F.sum(size).alias("_total"))
    g = df.groupingSets([[a, b], [a], [b], []], a, b).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level"))
    return g.join(F.broadcast(total)).withColumn("share", F.round(F.col("bytes") / F.col("_total"), 6)).drop("_total")


def compact_dictionary(df: DataFrame, groups: list[str], entry: str) -> DataFrame:
    """(groups, entry, code, uses): entries in use, numbered densely from 0 in their order."""
    used = df.where(F.col(entry).isNotNull()).groupBy(*groups, entry).agg(F.count(F.lit(1)).alias("uses"))
    return used.withColumn("code", (F.row_number().over(Window.partitionBy(*groups).orderBy(entry)) - 1).cast("bigint"))


def normalised_frequencies(df: DataFrame, groups: list[str], symbol: str, total: int) -> DataFrame:
    """(groups, symbol, frequency): counts scaled to add up to ``total``, each at least 1; what rounding leaves over or short goes to
    the commonest symbol (the smallest of those)."""
    n = df.groupBy(*groups, symbol).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups)
    f = n.withColumn("_f", F.greatest(F.lit(1), F.floor(F.col("_n") * total / F.sum("_n").over(w))))
    f = f.withColumn("_rest", F.lit(total) - F.sum("_f").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_n"), symbol)))
    return f.select(*groups, symbol, (F.col("_f") + F.when(F.col("_rank") == 1, F.col("_rest")).otherwise(0)).cast("bigint").alias("frequency"))


def ordered_digest(df: DataFrame, groups: list[str], order: str, text, bits: int = 256) -> DataFrame:
    """(groups, digest): a digest of the rows' digests in order. What is collected per group is one digest a row; groups are meant to
    be items of a directory, not records."""
    each = df.select(*groups, F.col(order).alias("_o"), F.sha2(text, bits).alias("_d"))
    return each.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_o", "_d"))).alias("_l")).select(*groups, F.sha2(F.array_join("_l._d", ""), bits).alias("digest"))


def cheapest(df: DataFrame, groups: list[str], choice: str, cost: str) -> DataFrame:
    """(groups, choice, cost): the choice of least total cost; a choice that is invalid (null cost) anywhere in the group is out; ties
    go to the smaller name."""
    total = df.groupBy(*groups, choice).agg(F.sum(cost).alias("_c"), F.count_if(F.col(cost).isNull()).alias("_bad")).where("_bad = 0")
    return total.groupBy(*groups).agg(F.min_by(F.struct(choice, "_c"), F.struct("_c", choice)).alias("_b")).select(*groups, F.col(f"_b.{choice}").alias(choice), F.col("_b._c").alias("cost"))


def pareto_choice(options: dict[str, list[tuple[str, int, float]]], slack: float = 0.01) -> dict[str, str]:
    """For each attribute one of its (codec, bytes, work), so that work is least while bytes stay within ``slack`` of the smallest
    total. Partial sums that another one beats in both are dropped as the attributes are added."""
    base = sum(min(o[1] for o in v) for v in options.values())
    limit = base * (1 + slack)
    front: list[tuple[int, float, tuple]] = [(0, 0.0, ())]
    rest = base
    for name, choices in options.items():
        rest -= min(o[1] for o in choices)
        made = sorted((b + size, w + work, (*picks, (name, codec))) for b, w, picks in front for codec, size, work in choices if b + size + rest <= limit)
        front, least = [], float("inf")
        for b, w, picks in made:
            if w < least:
                front.append((b, w, picks))
                least = w
    return dict(min(front, key=lambda f: (f[1], f[0]))[2]) if front else {}


def size_estimate(df: DataFrame, groups: list[str], order: str, size: str, windows: int = 4, width: int = 8) -> DataFrame:
    """(groups, estimate, peak): size of the whole by up to ``windows`` evenly spread windows of ``width`` rows, and the largest window."""
    w = Window.partitionBy(*groups)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    d = d.withColumn("_k", F.least(F.lit(windows), F.ceil(F.col("_n") / width)))
    slot = F.floor(F.col("_i") * F.col("_k") / F.col("_n"))
    start = F.ceil(slot * F.col("_n") / F.col("_k"))
    d = d.withColumn("_slot", slot).where(F.col("_i") - start < width)
    per = d.groupBy(*groups, "_slot").agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    return per.groupBy(*groups).agg(F.round(F.sum("_s") / F.sum("_c") * F.first("_n"), 3).alias("estimate"), F.max("_s").alias("peak"))


def palette(df: DataFrame, groups: list[str], colours: list[str], capacity: int) -> DataFrame:
    """(groups, distinct, exact): whether a group's different colours fit the palette as they are."""
    return df.groupBy(*groups).agg(F.count_distinct(*colours).alias("distinct")).withColumn("exact", F.col("distinct") <= capacity)


def compare_fit(made: DataFrame, wanted: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """One row: shown in both, missing from ``made``, stray in it, root mean square and worst distance of those in both."""
    m = made.select(key, *[F.col(a).alias(f"_m{a}") for a in axes], F.lit(True).alias("_here"))
    w = wanted.select(key, *axes, F.lit(True).alias("_there"))
    j = m.join(w, key, "full_outer")
    d2 = sum(((F.col(a) - F.col(f"_m{a}")) ** 2 for a in axes), F.lit(0.0))
    both = F.col("_here") & F.col("_there")
    return j.agg(
        F.count_if(both).alias("shown"), F.count_if(F.col("_here").isNull()).alias("missing"), F.count_if(F.col("_there").isNull()).alias("stray"),
        F.sqrt(F.avg(F.when(both, d2))).alias("rms"), F.sqrt(F.max(F.when(both, d2))).alias("worst"),
    )


def weighted_kmeans(df: DataFrame, axes: list[str], weight: str, centres: list[list[float]], rounds: int = 5, fixed: int = 0, restart: bool = True) -> list[list[float]]:
    """Lloyd's rounds from given centres: each assigns rows to the nearest centre (ties to the first) and takes weighted means. Centres
    are few and travel as literals; only their sums come back. A centre without rows restarts on the worst-fitted row, or stays without ``restart``; the first ``fixed`` centres stay as they are."""
    d = len(axes)
    df = df.select(*axes, weight).persist()
    for _ in range(rounds):
        far = [sum(((F.col(a) - c[i]) ** 2 for i, a in enumerate(axes)), F.lit(0.0)) for c in centres]
        best = F.array_min(F.array(*[F.struct(f.alias("d"), F.lit(k).alias("k")) for k, f in enumerate(far)]))
        at = df.select(*axes, F.col(weight).alias("_w"), best.alias("_b"))
        got = at.groupBy("_b.k").agg(*[(F.sum(F.col(a) * F.col("_w")) / F.sum("_w")).alias(f"m{i}") for i, a in enumerate(axes)], F.max_by(F.array(*axes), "_b.d").alias("worst"), F.max("_b.d").alias("gap")).collect()
        new = [None] * len(centres)
        for r in got:
            new[r["k"]] = [r[f"m{i}"] for i in range(d)]
        spare = sorted(got, key=lambda r: -r["gap"])
        for k, c in enumerate(new):
            if c is None or any(v is None for v in c):
                new[k] = list(spare.pop(0)["worst"]) if spare and restart else centres[k]
        centres = [*centres[:fixed], *new[fixed:]]
    df.unpersist()
    return centres


def lloyd_levels(df: DataFrame, groups: list[str], value: str, levels: int, rounds: int = 30, steps: int = 65536) -> DataFrame:
    """(groups, level, value, n): a group's best levels for a number between 0 and 1, from its quantiles on, by Lloyd's rounds: each value goes
    to the nearest level (ties to the lower), each level to the mean of its values; one without values stays. Values are counted in
    ``steps`` first, so that a group of any size is one small table."""
    v = (F.floor(F.col(value) * steps + 0.5) / steps).alias("_v")
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, v).agg(F.count(F.lit(1)).alias("_n"))
    kinds = dict(counts.dtypes)

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("_v")
        x, n = t.column("_v").to_numpy(), t.column("_n").to_numpy()
        upto = np.cumsum(n)
        at = x[np.searchsorted(upto, np.floor((np.arange(levels) + 0.5) / levels * upto[-1]), side="right")]
        size = np.zeros(levels, np.int64)
        for _ in range(rounds):
            best = np.abs(x[:, None] - at).round(9).argmin(1)
            size = np.bincount(best, weights=n, minlength=levels).astype(np.int64)
            at = np.where(size > 0, np.bincount(best, weights=x * n, minlength=levels) / np.maximum(size, 1), at)
        return pa.table([*[pa.array([t.column(g)[0].as_py()] * levels, t.column(g).type) for g in groups], pa.array(np.arange(levels), pa.int32()), pa.array(at), pa.array(size)], names=[*groups, "level", "value", "n"])

    return counts.groupBy(*groups).applyInArrow(fit, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", level int, value double, n bigint")
