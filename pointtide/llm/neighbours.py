"""The most similar vectors of every vector (problem 1).

Vectors go to posting lists around the centres of a balanced bisecting tree, fitted on a bounded sample. A centre is found by
walking a neighbour graph of the centres from the leaf that the tree names; vectors near a boundary are replicated to every
list whose centre is nearly as close. Each vector first searches its home list, which bounds the distance of its k-th
neighbour; the ratio of the centres' distances then rules out, list by list, those that cannot hold anything closer, and only
the others are searched as well.

Defined results: null, short, long and non-finite vectors take no part; repeated rows count once; equal vectors under
different ids are neighbours at distance 0 and searched once; among equal distances the smaller id comes first; fewer than k
others give fewer neighbours; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import small_enough
from .tree import fit_tree

__all__ = ["Lists", "neighbour_lists", "similar_pairs", "brute_force"]

LIST_ROWS = 400
SAMPLE_ROWS = 80_000
#: A list of more rows than this is split once more by the task that holds it.
SPLIT_ROWS = 8 * LIST_ROWS
#: A vector is replicated to every list whose centre is at most so many times as far as the nearest.
REPLICATE = 1.10
DEGREE = 48
BROADCAST_ROWS = 100_000


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def brute_force(x: np.ndarray, ids: np.ndarray, k: int) -> list[list[int]]:
    """Of each row of x the ids of its k nearest others, ties to the smaller id."""
    out = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        out.append([int(ids[j]) for j in np.lexsort((ids, d))[: min(k, len(x) - 1)]])
    return out


class Lists:
    """Centres, their neighbour graph, and the tree that names a first centre."""

    def __init__(self, sample: np.ndarray, rows: int, list_rows: int = LIST_ROWS, degree: int = DEGREE):
        self.tree = fit_tree(sample, max(8.0, list_rows * len(sample) / max(rows, 1)))
        c = self.centres = self.tree.centres
        g = min(degree, len(c) - 1)
        self.graph = np.zeros((len(c), g), np.int64)
        self.gap = np.zeros((len(c), g))  # distance between a centre and each of its neighbours
        for i in range(len(c) if g else 0):
            d = ((c - c[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argpartition(d, g - 1)[:g]
            near = near[np.argsort(d[near], kind="stable")]
            self.graph[i], self.gap[i] = near, np.sqrt(d[near])

    def around(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of each row to the graph neighbours of its centre."""
        out = np.empty((len(x), self.graph.shape[1]))
        for lo in range(0, len(x), 4096):
            s = slice(lo, lo + 4096)
            d = self.centres[self.graph[at[s]]] - x[s, None, :]
            out[s] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        return out

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centre, as far as the walk finds it, its distance, and the distances of its graph neighbours."""
        row, leaf, _ = self.tree.leaves(x)
        at = np.empty(len(x), np.int64)
        at[row] = leaf
        best = np.sqrt(_square(x - self.centres[at]))
        near = self.around(x, at)
        todo = np.arange(len(x))
        while len(todo) and near.shape[1]:
            j = near[todo].argmin(1)
            d = near[todo, j]
            better = d < best[todo]
            todo, j, d = todo[better], j[better], d[better]
            if not len(todo):
                break
            best[todo] = d
            at[todo] = self.graph[at[todo], j]
            near[todo] = self.around(x[todo], at[todo])
        return at, best, near

    def replicas(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, home): every row in its home list and in those at most ``ratio`` times as far."""
        at, best, near = self.home(x)
        r, j = np.nonzero(near <= best[:, None] * ratio)
        n = len(x)
        return np.concatenate([np.arange(n), r]), np.concatenate([at, self.graph[at[r], j]]), np.concatenate([np.ones(n, bool), np.zeros(len(r), bool)])

    def more(self, x: np.ndarray, radius: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the further lists that may hold a vector within ``radius`` of the row and not in its home list.

        A vector of list j, within r of a row at distances d0 of its own and dj of the other centre, is at least dj - r from
        its centre and at most d0 + r from the row's; beyond the ratio it would be the row's list's, or replicated to it.
        Nor can it lie beyond the plane half-way between the centres by more than r."""
        at, best, near = self.home(x)
        if not near.shape[1]:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        r, d0 = radius[:, None], best[:, None]
        plane = (near**2 - d0**2) / (2 * np.maximum(self.gap[at], 1e-300))
        take = (ratio * (near - r) < d0 + r) & (plane <= r)
        row, j = np.nonzero(take)
        lists = self.graph[at[row], j]
        # where even the farthest neighbour counts, the rest of the centres are tried as well
        wide = np.flatnonzero(take[:, -1]) if len(self.centres) > near.shape[1] + 1 else np.empty(0, np.int64)
        parts = [(row, lists)]
        step = max(1, 4_000_000 // self.centres.size)
        for lo in range(0, len(wide), step):
            w = wide[lo:lo + step]
            d = np.sqrt(((x[w][:, None, :] - self.centres[None]) ** 2).sum(2))
            gap = np.sqrt(((self.centres[at[w]][:, None, :] - self.centres[None]) ** 2).sum(2))
            ok = (ratio * (d - radius[w][:, None]) < best[w][:, None] + radius[w][:, None]) & ((d**2 - best[w][:, None] ** 2) / (2 * np.maximum(gap, 1e-300)) <= radius[w][:, None])
            ok[np.arange(len(w)), at[w]] = False
            ok[np.arange(len(w))[:, None], self.graph[at[w]]] = False
            a, b = np.nonzero(ok)
            parts.append((w[a], b))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _vectors(column, d: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """(query row, data row, distance) of the k nearest data rows of each query, itself excluded; ties to the smaller id."""
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    centre = x.mean(0)
    xc, qc = x - centre, q - centre
    x2 = _square(xc)
    rows, cols, dist = [], [], []
    step = max(8, min(512, 10_000_000 // max(len(x), 1)))  # a block of distances stays below 80 MB
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        d = _square(qc[part])[:, None] + x2 - 2 * (qc[part] @ xc.T)
        d[qid[part, None] == xid] = np.inf
        n = min(k + 4, len(x))  # a few more, since these distances are rounded
        near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(x) else np.broadcast_to(np.arange(n), (d.shape[0], n))
        near = np.sort(near, 1)
        exact = ((q[part, None, :] - x[near]) ** 2).sum(2)
        exact[qid[part, None] == xid[near]] = np.inf
        # equal rounded distances at the edge: such rows are done in full
        if n < len(x):
            kth = np.partition(exact, k - 1, axis=1)[:, k - 1]
            last = np.take_along_axis(d, near, 1).max(1)
            for i in np.flatnonzero(~(last > kth * (1 + 1e-9) + 1e-12)):
                full = ((q[lo + i] - x) ** 2).sum(1)
                full[qid[lo + i] == xid] = np.inf
                best = np.argsort(full, kind="stable")[:n]
                near[i], exact[i] = best, full[best]
        by = np.argsort(exact, axis=1, kind="stable")[:, :k]
        exact = np.take_along_axis(exact, by, 1)
        near = np.take_along_axis(near, by, 1)
        i, j = np.nonzero(np.isfinite(exact))
        rows.append(lo + i)
        cols.append(order[near[i, j]])
        dist.append(exact[i, j])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """What ``_nearest`` gives, for lists of any length: a list of more than SPLIT_ROWS is split once more, here where its rows are. Queries
    near each other share a search of the parts around them, whose k-th distances rule out all parts farther away by their radii."""
    if len(x) <= SPLIT_ROWS:
        return _nearest(q, qid, x, xid, k)
    some = x[:: max(1, len(x) // SAMPLE_ROWS)]
    tree = fit_tree(some, max(8.0, LIST_ROWS * len(some) / len(x)))
    row, leaf, _ = tree.leaves(x)
    order = np.argsort(leaf, kind="stable")
    names, first = np.unique(leaf[order], return_index=True)
    parts = np.split(row[order], first[1:])
    centre = np.array([x[p].mean(0) for p in parts])
    radius = np.array([np.sqrt(_square(x[p] - c).max()) for p, c in zip(parts, centre)])
    many = np.array([len(p) for p in parts])
    at, qleaf, _ = tree.leaves(q)
    rows, cols, dist = [], [], []
    for g in np.unique(qleaf):
        mine = at[qleaf == g]
        mid = q[mine].mean(0)
        far = np.sqrt(_square(centre - mid))
        least = far - radius - np.sqrt(_square(q[mine] - mid).max())
        near = np.argsort(far, kind="stable")
        used = near[: int(np.searchsorted(np.cumsum(many[near]), 2 * LIST_ROWS + k)) + 1]
        while True:
            here = np.concatenate([parts[p] for p in used])
            r, c, dd = _nearest(q[mine], qid[mine], x[here], xid[here], k)
            full = np.bincount(r, minlength=len(mine)) >= min(k, len(x) - 1)
            reach = np.sqrt(dd.max()) * (1 + 1e-9) if full.all() else np.inf
            need = np.flatnonzero(least <= reach)
            if np.isin(need, used).all():
                break
            used = np.union1d(need, used)
        rows.append(mine[r])
        cols.append(here[c])
        dist.append(dd)
    by = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(rows)[by], np.concatenate(cols)[by], np.concatenate(dist)[by]


def _listed(row, values, n):
    """A list array of ``values``, grouped by ascending ``row``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), pa.array(values))


def neighbour_lists(sites: DataFrame, rows: int, d: int, k: int, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS, ratio: float = REPLICATE) -> DataFrame:
    """(id, near array<struct<dist, id>>): the k nearest other rows of each row of ``sites`` (id, vec), whose vectors differ."""
    part = min(1.0, sample_rows / max(rows, 1))
    sample = sites.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else sites
    x = _vectors(sample.select("vec").limit(2 * sample_rows).toArrow().column(0), d)
    lists = Lists(x, rows, list_rows)

    def replicate(batches):
        for b in batches:
            if b.num_rows:
                at, where, home = lists.replicas(_vectors(b.column("vec"), d), ratio)
                t = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([t.column("id"), t.column("vec"), pa.array(where.astype(np.int32)), pa.array(home)], names=["id", "vec", "list", "home"])

    def at_home(t: pa.Table) -> pa.Table:
        x, ids, own = _vectors(t.column("vec"), d), t.column("id").to_numpy(), t.column("home").to_numpy()
        q = np.flatnonzero(own)
        if not len(q):
            return pa.table({"id": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float32())), "dist": pa.array([], pa.list_(pa.float64())), "other": pa.array([], pa.list_(pa.int64()))})
        row, col, dist = _search(x[q], ids[q], x, ids, k)
        return pa.table({"id": ids[q], "vec": t.column("vec").take(pa.array(q)), "dist": _listed(row, dist, len(q)), "other": _listed(row, ids[col], len(q))})

    def route(batches):
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("vec"), d)
                dist = b.column("dist")
                n = np.diff(dist.offsets.to_numpy())
                flat = dist.flatten().to_numpy()
                ends = np.cumsum(n)
                radius = np.where(n >= k, np.sqrt(flat[np.maximum(ends - 1, 0)]) if len(flat) else np.inf, np.inf)
                at, where = lists.more(x, radius * (1 + 1e-9), ratio)
                t = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([t.column("id"), t.column("vec"), pa.array(where.astype(np.int32)), pa.array(radius[at] ** 2)], names=["id", "vec", "list", "most"])

    def further(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "dist": pa.array([], pa.list_(pa.float64())), "other": pa.array([], pa.list_(pa.int64()))})
        q, qid, most = _vectors(left.column("vec"), d), left.column("id").to_numpy(), left.column("most").to_numpy()
        x, ids = _vectors(right.column("vec"), d), right.column("id").to_numpy()
        row, col, dist = _search(q, qid, x, ids, k)
        good = dist <= most[row] * (1 + 1e-9)
        row, col, dist = row[good], col[good], dist[good]
        has, row = np.unique(row, return_inverse=True)
        return pa.table({"id": qid[has], "dist": _listed(row, dist, len(has)), "other": _listed(row, ids[col], len(has))})

    index = sites.select("id", "vec").mapInArrow(replicate, "id bigint, vec array<float>, list int, home boolean").persist()
    first = index.groupBy("list").applyInArrow(at_home, "id bigint, vec array<float>, dist array<double>, other array<bigint>").persist()
    asked = first.mapInArrow(route, "id bigint, vec array<float>, list int, most double")
    # a list's own vectors only: replicas are at home in another list, which the bounds select by itself
    second = asked.groupBy("list").cogroup(index.where("home").groupBy("list")).applyInArrow(further, "id bigint, dist array<double>, other array<bigint>")
    zipped = F.arrays_zip("dist", F.col("other").alias("id"))
    found = first.select("id", zipped.alias("z")).union(second.select("id", zipped.alias("z")))
    zs = F.flatten(F.collect_list("z"))
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(zs)), 1, k).alias("near"))


def similar_pairs(df: DataFrame, key: str, vector: str, d: int, k: int, **options) -> DataFrame:
    """(key_a, key_b), the smaller first: every pair of which at least one is among the other's k nearest."""
    p = F.col(vector)
    valid = (
        df.where(F.col(key).isNotNull() & (F.size(p) == d))
        .where((F.size(F.array_compact(p)) == d) & ~F.isnan(F.array_max(p)) & (F.array_max(p) < float("inf")) & (F.array_min(p) > float("-inf")))
        .select(F.col(key).cast("bigint").alias("id"), p.cast("array<float>").alias("vec"))
    )
    sites = valid.groupBy("vec").agg(F.min("id").alias("id"), F.max("id").alias("last")).persist()
    near = neighbour_lists(sites, sites.count(), d, k, **options)
    seen = near.select(F.col("id").alias("q"), F.explode("near").alias("n")).select("q", F.col("n.dist").alias("dist"), F.col("n.id").alias("other"))
    copies = sites.where("id < last").select("vec", F.col("id").alias("site")).persist()
    if small_enough(copies, 0):
        pairs = seen.select(F.least("q", "other").alias("a"), F.greatest("q", "other").alias("b"))
    else:
        few = small_enough(copies, BROADCAST_ROWS)
        members = valid.join(F.broadcast(copies) if few else copies, "vec").select("site", "id").distinct().persist()
        # the k + 1 smallest ids of a vector are all that can be anyone's neighbour
        ranked = members.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("id"))).where(F.col("n") <= k + 1)
        least = ranked.groupBy("site").agg(F.array_sort(F.collect_list("id")).alias("ids")).persist()
        least = F.broadcast(least) if few else least
        wide = seen.join(least.withColumnRenamed("site", "other"), "other", "left").select("q", "dist", F.explode(F.coalesce("ids", F.array("other"))).alias("other"))
        own = least.select(F.col("site").alias("q"), F.lit(0.0).alias("dist"), F.explode("ids").alias("other"))
        wide = wide.union(own).join(least.withColumnRenamed("site", "q").withColumnRenamed("ids", "mine"), "q", "left")
        wide = wide.select(F.explode(F.coalesce("mine", F.array("q"))).alias("q"), "dist", "other").where("q != other")
        best = wide.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("dist", "other"))).where(F.col("n") <= k)
        # every further copy has the smallest ids as its neighbours
        rest = members.join(least, "site").where(~F.array_contains("ids", F.col("id"))).select(F.col("id").alias("q"), F.explode(F.slice("ids", 1, k)).alias("other"))
        every = best.select("q", "other").union(rest)
        pairs = every.select(F.least("q", "other").alias("a"), F.greatest("q", "other").alias("b"))
    return pairs.distinct().select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
