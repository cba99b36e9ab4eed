"""Nearest neighbours, grids and components in space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import small_enough
from .graph import connected_components
from .quantile import grouped_ranks

__all__ = ["nearest_rows", "nth_neighbour_distances", "neighbour_pairs", "components", "upper_medians", "nearest_level", "local_planes"]

#: Rows of a leaf of the local search tree.
LEAF = 64
#: Groups above this are cut into blocks along their widest axis.
BLOCK_ROWS = 200_000


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        p = x[at]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        half = np.argpartition(p[:, axis], len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2:]]]
    return out


def nearest_rows(x: np.ndarray, k: int, self_too: bool = False, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances), each n by k: the k nearest rows of every row of x, or of those of ``among``, exactly; ties to the smaller row.
    Missing ones are -1 and infinite."""
    n = len(x)
    rows, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    y = x if among is None else among
    if not n or not len(y):
        return rows, dist
    self_too = self_too or among is not None
    leaves = _leaves(y)
    lo = np.array([y[a].min(0) for a in leaves])
    hi = np.array([y[a].max(0) for a in leaves])
    for at in leaves if among is None else _leaves(x):
        gap = np.sqrt((np.maximum(0, np.maximum(lo - x[at].max(0), x[at].min(0) - hi)) ** 2).sum(1))
        order = np.argsort(gap, kind="stable")
        size = np.cumsum([len(leaves[j]) for j in order[: 8 + k]])
        first = max(1, int(np.searchsorted(size, k + 1) + 1))
        while True:
            cand = np.sort(np.concatenate([leaves[j] for j in order[:first]]))
            d = np.sqrt(((x[at][:, None] - y[cand][None]) ** 2).sum(2))
            if not self_too:
                d[at[:, None] == cand[None]] = np.inf
            by = np.argsort(d, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(d, by, 1)
            reach = best[:, -1].max() if best.shape[1] == k else np.inf
            needed = int((gap <= reach).sum()) if np.isfinite(reach) else len(leaves)
            if needed <= first or first >= len(leaves):
                break
            first = needed
        m = best.shape[1]
        ok = np.isfinite(best)
        rows[at[:, None], np.arange(m)] = np.where(ok, cand[by], -1)
        dist[at[:, None], np.arange(m)] = best
    return rows, dist


def _blocked(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """(g..., key, x, y, z) of the finite rows."""
    ok = F.lit(True)
    for a in "xyz":
        ok = ok & (F.abs(F.col(a)) < float("inf"))
    return df.where(ok).select(*groups, F.col(key).alias("key"), *[F.col(a).cast("double").alias(a) for a in "xyz"])


def nth_neighbour_distances(df: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    """(groups, key, distance): distance of each row (x, y, z) to its n-th nearest other row of the group; groups of no more than n
    rows have none.

    Each group is searched in blocks of at most BLOCK_ROWS rows along x. A block also gets the rows within a margin that its
    density suggests; rows whose n-th distance exceeds the margin are searched again with a doubled one, until none is left."""
    rows = _blocked(df, groups, key).persist()
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{g} {kinds[g]}" for g in groups) + f", key {kinds['key']}, distance double"
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    sized = rows.join(sizes.where(F.col("_n") > n), groups)

    def whole(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(a).to_numpy() for a in "xyz"], 1)
        _, d = nearest_rows(x, n)
        return t.select([*groups, "key"]).append_column("distance", pa.array(d[:, -1]))

    found = sized.where(F.col("_n") <= BLOCK_ROWS).groupBy(*groups).applyInArrow(whole, out)
    big = sized.where(F.col("_n") > BLOCK_ROWS)
    if not big.isEmpty():
        found = found.union(_big_groups(big, groups, n, out))
    return found.withColumnRenamed("key", key)


def _big_groups(big: DataFrame, groups: list[str], n: int, out: str) -> DataFrame:
    cuts = big.groupBy(*groups).agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("_cuts"))
    placed = big.join(cuts, groups).withColumn("_b", F.size(F.filter("_cuts", lambda c: c <= F.col("x")))).drop("_cuts").persist()
    # a group's blocks, at most 64, go along with its rows, each of which then names the few blocks that its margin reaches
    spans = placed.groupBy(*groups, "_b").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    spans = spans.groupBy(*groups).agg(F.collect_list(F.struct("_b", "_x0", "_x1")).alias("_spans")).persist()
    margin, todo, done = 1 / 256, placed.select(*groups, "key"), None
    while True:
        # every row goes to the blocks whose span, widened by the margin, holds it; only blocks that still ask are kept
        ask = placed.join(todo, [*groups, "key"], "left_semi").select(*groups, "key", "_b")
        need = ask.select(*groups, "_b").distinct()
        wide = (F.col("_hi") - F.col("_lo")) * margin
        reached = F.explode(F.filter("_spans", lambda s: (F.col("x") >= s["_x0"] - wide) & (F.col("x") <= s["_x1"] + wide))).alias("_s")
        near = placed.drop("_b").join(F.broadcast(spans) if small_enough(spans, 10_000) else spans, groups)
        near = near.select(*placed.drop("_b").columns, reached).select(*placed.drop("_b").columns, "_s._b", "_s._x0", "_s._x1").join(need, [*groups, "_b"], "left_semi")
        asked = near.join(ask.withColumn("_ask", F.lit(True)), [*groups, "key", "_b"], "left").withColumn("_wide", wide)

        def part(t: pa.Table) -> pa.Table:
            x = np.stack([t.column(a).to_numpy() for a in "xyz"], 1)
            mine = t.column("_ask").fill_null(False).to_numpy(zero_copy_only=False)
            _, d = nearest_rows(x, n)
            edge = np.minimum(x[:, 0] - (t.column("_x0").to_numpy() - t.column("_wide").to_numpy()), (t.column("_x1").to_numpy() + t.column("_wide").to_numpy()) - x[:, 0])
            sure = (d[:, -1] <= edge) | (t.column("_wide").to_numpy() >= t.column("_hi").to_numpy() - t.column("_lo").to_numpy())
            dist = np.where(sure, d[:, -1], np.nan)
            return t.select([*groups, "key"]).append_column("distance", pa.array(dist)).filter(pa.array(mine))

        got = asked.groupBy(*groups, "_b").applyInArrow(part, out).persist()
        good = got.where(~F.isnan("distance"))
        done = good if done is None else done.union(good)
        todo = got.where(F.isnan("distance")).select(*groups, "key")
        if todo.isEmpty():
            return done
        margin *= 4


def upper_medians(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, upper_median): the element at position n div 2 of the sorted values."""
    r = grouped_ranks(df, groups, [value], lambda n: (F.floor(n / 2), F.floor(n / 2)), every=False)
    return r.where(F.col(f"{value}_low").isNotNull()).select(*groups, F.col(f"{value}_low").cast(dict(df.dtypes)[value]).alias("upper_median"))


def neighbour_pairs(df: DataFrame, groups: list[str], key: str, radius: float) -> DataFrame:
    """(groups, a, b), a < b: the pairs at most ``radius`` apart, through an equi join of grid cells: one side in its own cell, the
    other in the cell and the 13 around it that come later, so that each pair of cells meets once. Rows beyond the grid's reach share
    its outermost cells."""
    rows = _blocked(df, groups, key)
    edge = float(1 << 60)
    cell = [F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), F.col(a) / radius))).cast("bigint").alias(f"c{a}") for a in "xyz"]
    own = rows.select(*groups, F.col("key").alias("a"), "x", "y", "z", *cell)
    later = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{a}") for v, a in zip(m, "xyz")]) for m in later])).alias("o")
    near = rows.select(*groups, F.col("key").alias("b"), *[F.col(a).alias(f"n{a}") for a in "xyz"], *cell, moves)
    near = near.select(*groups, "b", "nx", "ny", "nz", *[(F.col(f"c{a}") + F.col(f"o.o{a}")).alias(f"c{a}") for a in "xyz"], ((F.col("o.ox") == 0) & (F.col("o.oy") == 0) & (F.col("o.oz") == 0)).alias("same"))
    gap = sum(((F.col(a) - F.col(f"n{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    met = own.join(near, [*groups, "cx", "cy", "cz"]).where((~F.col("same") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & (gap <= radius * radius))
    return met.select(*groups, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(df: DataFrame, groups: list[str], key: str, radius: float, least: int = 1) -> DataFrame:
    """(key, component): records connected through steps of at most ``radius`` within their group, in components of at least
    ``least`` records; a component is named by its smallest key."""
    links = neighbour_pairs(df, groups, key, radius)
    found = connected_components(links, "a", "b")
    every = df.select(F.col(key).alias("node")).distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = every.groupBy("component").count().where(F.col("count") >= least).select("component")
    return every.join(sizes, "component").select(F.col("node").alias(key), "component")


def nearest_level(value, levels: list[float], upper: bool = False):
    """Index of the nearest entry of a sorted table, as a column; half-way values go to the lower or the upper entry."""
    out = F.lit(0)
    for i, (a, b) in enumerate(zip(levels, levels[1:])):
        mid = (a + b) / 2
        out = F.when(value >= mid if upper else value > mid, F.lit(i + 1)).otherwise(out)
    return out


def local_planes(df: DataFrame, groups: list[str], key: str, k: int = 24) -> DataFrame:
    """(key, nx, ny, nz, flatness): unit normal of the plane through the k nearest rows, itself included, weighted by o, and how flat
    they lie (0 to 1)."""
    rows = df.select(*groups, F.col(key).alias("key"), *[F.col(a).cast("double").alias(a) for a in ("x", "y", "z", "o")])
    kind = dict(rows.dtypes)["key"]

    def planes(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(a).to_numpy() for a in "xyz"], 1)
        w = np.maximum(t.column("o").to_numpy(), 1e-6)
        near, d = nearest_rows(x, min(k, len(x)), True)
        ww = np.where(near >= 0, w[near], 0)
        mean = (ww[:, :, None] * x[near]).sum(1) / ww.sum(1)[:, None]
        c = x[near] - mean[:, None]
        cov = np.einsum("nk,nki,nkj->nij", ww, c, c) / ww.sum(1)[:, None, None]
        val, vec = np.linalg.eigh(cov)
        flat = np.where(val[:, 1] > 1e-12 * val[:, 2], np.clip(1 - val[:, 0] / np.maximum(val[:, 1], 1e-300), 0, 1), 0.0)
        v = vec[:, :, 0]
        # a normal has no side by itself: its largest component is made positive
        side = np.sign(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1))
        v = v * np.where(side == 0, 1, side)
        return pa.table({"key": t.column("key"), "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "flatness": flat})

    return rows.groupBy(*groups).applyInArrow(planes, f"key {kind}, nx double, ny double, nz double, flatness double").withColumnRenamed("key", key)
