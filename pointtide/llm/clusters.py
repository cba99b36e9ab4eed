"""Groups of mutually similar records (problem 4).

A bisecting k-means tree splits the space at the node of the largest dispersion until each leaf fits one task or is compact.
To link records it is fitted on a bounded sample, which only divides the work, and walked by every record; a record nearer than half the linking distance to a splitting
plane goes to both sides, so that every pair of alike records meets in some leaf. Each leaf links its alike pairs exactly,
and the leaves' groups are joined through the records they share. In a dense place one record stands for those of a small cell
around it, so that any number of records within the linking distance of each other are linked without listing their pairs. Where the leaves themselves are the result (``bisecting_leaves``), all records fit the tree.

Defined results: records with null, short or non-finite vectors take no part; repeated rows (same id) count once; equal
vectors under different ids are alike; ties in "most typical" go to the smaller id; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, min_labels
from ..operators.quantile import grouped_ranks
from ..util import finite, small_enough
from .tree import Tree, fit_tree, power_direction

__all__ = ["points", "similarity_clusters", "describe_clusters", "bisecting_leaves", "alike_pairs", "alike_labels"]

#: Records a leaf should hold, and the most rows that the tree is fitted on.
LEAF_ROWS = 12_000
SAMPLE_ROWS = 60_000
BROADCAST_ROWS = 100_000
#: Records whose part of the tree one task grows.
TASK_ROWS = 250_000
#: Rows of a cell of diagonal eps from which on one row stands for it.
DENSE = 8


def points(df: DataFrame, key: str, parts: list[tuple[str, int, float]]) -> DataFrame:
    """(id, p0, p1, ...): the components of the array columns ``parts`` (name, length, factor), as floats, for the rows in
    which all are present and finite. Factors are applied later, in double precision."""
    ok, cols = F.col(key).isNotNull(), []
    for name, n, _ in parts:
        ok = ok & F.col(name).isNotNull() & (F.size(name) == n)
    picked = df.where(ok)
    for name, n, _ in parts:
        cols += [F.col(name)[i] for i in range(n)]
    picked = picked.select(F.col(key).cast("bigint").alias("id"), *[(c.cast("float") + F.lit(0.0).cast("float")).alias(f"p{i}") for i, c in enumerate(cols)])
    good = F.lit(True)
    for i in range(len(cols)):
        good = good & finite(F.col(f"p{i}"))
    return picked.where(good)


def _fit(pts: DataFrame, rows: int, factors: np.ndarray, leaf_rows: int, sample_rows: int, compact: float):
    """The tree, and the box into which vectors are clipped before they walk it (clipping never parts alike vectors more)."""
    d = len(factors)
    part = min(1.0, sample_rows / max(rows, 1))
    sample = pts.drop("id")
    if part < 1.0:
        sample = sample.where(F.pmod(F.xxhash64("id", F.lit(20)), F.lit(1 << 30)) < int(part * (1 << 30)))
    x = sample.limit(2 * sample_rows).toPandas().to_numpy(np.float64).reshape(-1, d) * factors
    if not len(x):
        return fit_tree(x, 1), np.zeros(d), np.zeros(d)
    low, high = np.percentile(x, [1, 99], axis=0)
    reach = np.maximum(high - low, 1e-6)
    low, high = low - reach, high + reach
    return fit_tree(np.clip(x, low, high), max(8.0, leaf_rows * len(x) / max(rows, 1)), compact), low, high


def _matrix(batch: pa.RecordBatch, d: int, factors: np.ndarray) -> np.ndarray:
    return np.stack([batch.column(f"p{i}").to_numpy(zero_copy_only=False) for i in range(d)], 1).astype(np.float64) * factors


def _spread(pts: DataFrame, tree: Tree, low, high, factors: np.ndarray, halo: float) -> DataFrame:
    """Every row with its leaf, home or not."""
    d = len(factors)
    names = pts.columns

    def walk(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.clip(_matrix(b, d, factors), low, high)
            at, leaf, home = tree.leaves(x, halo)
            out = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf.astype(np.int32)), pa.array(home)], names=[*names, "leaf", "home"])

    fields = ", ".join(f"{n} {t}" for n, t in pts.dtypes)
    return pts.mapInArrow(walk, f"{fields}, leaf int, home boolean")


def _cells(x: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, steps, dims): the cell of side eps of each row along the (up to) four widest dimensions, numbered so that the keys of
    neighbouring cells differ by sums of steps."""
    n, d = x.shape
    low, high = np.percentile(x, [2, 98], axis=0)
    dims = np.argsort(low - high, kind="stable")[: min(4, d)]
    side = eps * (1 + 1e-9)
    # far outliers share the outermost cells, so that the others keep their precision
    cell = np.clip(np.floor((x[:, dims] - np.median(x[:, dims], axis=0)) / side), -(2.0**40), 2.0**40).astype(np.int64)
    # dense numbers per dimension that keep neighbours neighbours: gaps of more than one cell become gaps of two
    sizes = []
    for k in range(len(dims)):
        u, inv = np.unique(cell[:, k], return_inverse=True)
        dense = np.concatenate([[0], np.cumsum(np.minimum(np.diff(u), 2))]) + 1
        cell[:, k] = dense[inv]
        sizes.append(int(dense[-1]) + 2)
    if np.prod([float(s) for s in sizes]) > 2.0**62:
        cell, sizes = cell[:, :2], sizes[:2]
    steps = np.ones(len(sizes), np.int64)
    for k in range(len(sizes) - 2, -1, -1):
        steps[k] = steps[k + 1] * sizes[k + 1]
    key = cell @ steps
    return key, steps, dims


def alike_pairs(x: np.ndarray, eps: float, chunk: int = 1_500_000):
    """Yields (i, j) index arrays that together hold every pair of rows of x at a Euclidean distance of at most eps.

    Rows are sorted into cells of side eps along the (up to) four widest dimensions; only neighbouring cells are compared."""
    n, d = x.shape
    if n < 2:
        return
    key, steps, dims = _cells(x, eps)
    order = np.argsort(key, kind="stable")
    key, xs = key[order], x[order]
    cells, first = np.unique(key, return_index=True)
    last = np.append(first[1:], n)
    # moves in all but the last dimension; there the cells -1, 0, 1 are one run of keys
    moves = np.array(np.meshgrid(*[[-1, 0, 1]] * (len(steps) - 1), indexing="ij")).reshape(len(steps) - 1, -1).T if len(steps) > 1 else np.zeros((1, 0), np.int64)
    limit = eps * eps
    for move in moves:
        shift = int(move @ steps[:-1]) if len(move) else 0
        if shift < 0:
            continue
        if shift == 0:
            # own run: pairs after oneself, up to the end of the next cell
            lo = np.arange(n) + 1
            hi = last[np.searchsorted(cells, key + 1, side="right") - 1]
            hi = np.maximum(hi, lo)
        else:
            a = np.searchsorted(cells, key + shift - 1, side="left")
            b = np.searchsorted(cells, key + shift + 1, side="right")
            lo = np.append(first, n)[a]
            hi = np.append(first, n)[b]
        many = hi - lo
        some = np.flatnonzero(many > 0)
        if not len(some):
            continue
        ends = np.cumsum(many[some])
        start = 0
        while start < len(some):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chunk, side="right")))
            rows = some[start:stop]
            reps = many[rows]
            i = np.repeat(rows, reps)
            off = np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
            j = np.repeat(lo[rows], reps) + off
            near = np.flatnonzero(np.abs(xs[i, dims[0]] - xs[j, dims[0]]) <= eps)
            i, j = i[near], j[near]
            dist = np.zeros(len(i))
            for k in range(d):
                dist += (xs[i, k] - xs[j, k]) ** 2
            ok = dist <= limit
            if ok.any():
                yield order[i[ok]], order[j[ok]]
            start = stop


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any row of a is within eps of any row of b."""
    gap = lambda p, lo, hi: np.maximum(0, np.maximum(lo - p, p - hi))
    a = a[(gap(a, b.min(0), b.max(0)) ** 2).sum(1) <= eps * eps * (1 + 1e-9)]
    if len(a):
        b = b[(gap(b, a.min(0), a.max(0)) ** 2).sum(1) <= eps * eps * (1 + 1e-9)]
    for i in range(0, len(a) if len(b) else 0, 512):
        for j in range(0, len(b), 2048):
            dist = np.zeros((len(a[i : i + 512]), len(b[j : j + 2048])))
            for k in range(a.shape[1]):
                dist += (a[i : i + 512, None, k] - b[None, j : j + 2048, k]) ** 2
            if (dist <= eps * eps).any():
                return True
    return False


def _across(x: np.ndarray, label: np.ndarray, loose: np.ndarray, eps: float) -> np.ndarray:
    """``label`` after joining components that hold alike records, at least one of which is ``loose``. Records of one cell and component
    form a group; two groups are compared until a pair is found, and not at all once their components are one."""
    key, steps, _ = _cells(x, eps)
    order = np.lexsort((label, key))
    key, own = key[order], label[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
    last = np.append(first[1:], len(x))
    gkey, glabel, free = key[first], own[first], np.logical_or.reduceat(loose[order], first)
    lo, hi = np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)
    up = np.arange(len(x))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for move in np.array(np.meshgrid(*[[-1, 0, 1]] * len(steps), indexing="ij")).reshape(len(steps), -1).T:
        shift = int(move @ steps)
        if shift < 0:
            continue
        begin, end = np.searchsorted(gkey, gkey + shift, side="left"), np.searchsorted(gkey, gkey + shift, side="right")
        if not shift:
            begin = np.arange(len(gkey)) + 1
        many = np.maximum(end - begin, 0)
        i = np.repeat(np.arange(len(gkey)), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        near = (free[i] | free[j]) & (glabel[i] != glabel[j])
        i, j = i[near], j[near]
        apart = (np.maximum(0, np.maximum(lo[i] - hi[j], lo[j] - hi[i])) ** 2).sum(1)
        for k in np.argsort(apart, kind="stable")[: np.searchsorted(np.sort(apart), eps * eps * (1 + 1e-9), side="right")]:
            p, q = root(glabel[i[k]]), root(glabel[j[k]])
            if p != q and _touch(x[order[first[i[k]] : last[i[k]]]], x[order[first[j[k]] : last[j[k]]]], eps):
                up[max(p, q)] = min(p, q)
    while not np.array_equal(up, up[up]):
        up = up[up]
    return up[label]


def alike_labels(x: np.ndarray, eps: float, dense: int = DENSE) -> np.ndarray:
    """Of each row of x the smallest row that it is connected with through rows at most eps apart.

    The rows of a cell whose diagonal is eps are alike; where it has ``dense`` rows or more, one row stands for it among the pairs,
    and the others are only compared with what is not connected with them yet, so that the work doesn't grow with the pairs of a
    dense place."""
    n, d = x.shape
    label, loose = np.arange(n), np.zeros(n, bool)
    small = np.floor(x / (eps * (1 - 1e-6) / np.sqrt(d)))
    by = np.lexsort(small.T)
    fresh = np.concatenate([[True], (small[by][1:] != small[by][:-1]).any(1)]) if n else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(fresh), n))
    crowded = np.repeat(size >= dense, size)
    if crowded.any():
        heads = np.minimum.reduceat(by, np.flatnonzero(fresh))
        label[by] = np.where(crowded, np.repeat(heads, size), by)
        loose = label != np.arange(n)
    kept = np.flatnonzero(~loose)
    part_i, part_j = [], []
    for i, j in alike_pairs(x[kept], eps):
        part_i.append(kept[i])
        part_j.append(kept[j])
        if sum(map(len, part_i)) > 8_000_000:
            label = min_labels(n, label[np.concatenate(part_i)], label[np.concatenate(part_j)])[label]
            part_i, part_j = [], []
    if part_i:
        label = min_labels(n, label[np.concatenate(part_i)], label[np.concatenate(part_j)])[label]
    return _across(x, label, loose, eps) if loose.any() else label


def _leaf_links(d: int, factors: np.ndarray, eps: float):
    def links(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = np.stack([table.column(f"p{i}").to_numpy() for i in range(d)], 1).astype(np.float64) * factors
        first = np.argsort(ids, kind="stable")
        ids, x = ids[first], x[first]
        label = alike_labels(x, eps)
        size = np.bincount(label, minlength=len(ids))
        keep = size[label] > 1
        return pa.table({"id": ids[keep], "part": ids[label[keep]]})

    return links


def _sites(pts: DataFrame, d: int) -> DataFrame:
    """One row per distinct vector: its smallest and largest id. Partial aggregation keeps a hot vector from one task."""
    return pts.groupBy(*[f"p{i}" for i in range(d)]).agg(F.min("id").alias("id"), F.max("id").alias("last"))


def similarity_clusters(df: DataFrame, key: str, parts: list[tuple[str, int, float]], eps: float, least: int, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, cluster_id): the members of every largest set of records connected through records at most ``eps`` apart (Euclidean
    distance over the scaled components of ``parts``) that has at least ``least`` members; cluster_id is its smallest key."""
    factors = np.array([f for _, n, f in parts for _ in range(n)], dtype=np.float64)
    d = len(factors)
    pts = points(df, key, parts)
    tree, low, high = _fit(pts, df.count(), factors, leaf_rows, sample_rows, eps / 2)
    sites = _sites(pts, d).persist()
    spread = _spread(sites.drop("last"), tree, low, high, factors, eps / 2 * (1 + 1e-6))
    # links of one leaf, as (record, smallest record of its group in that leaf)
    own = spread.groupBy("leaf").applyInArrow(_leaf_links(d, factors, eps), "id bigint, part bigint").persist()
    joined = own.groupBy("id").agg(F.min("part").alias("part"), F.max("part").alias("other"))
    # a record in several leaves ties their groups together
    ties = own.join(joined.where("part < other").select("id", F.col("part").alias("to")), "id").where("part != to").select(F.col("part").alias("src"), F.col("to").alias("dst"))
    roots = connected_components(ties)
    copies = sites.where("id < last")
    labelled = (
        joined.select("id", "part").join(roots.withColumnRenamed("node", "part"), "part", "left")
        .select("id", F.coalesce("component", "part").alias("cluster_id"))
    )
    if not small_enough(copies, 0):
        few = small_enough(copies, BROADCAST_ROWS)
        where = copies.join(labelled, "id", "left").select(*[f"p{i}" for i in range(d)], F.coalesce("cluster_id", "id").alias("cluster_id"))
        rest = pts.join(F.broadcast(where) if few else where, [f"p{i}" for i in range(d)]).select("id", "cluster_id")
        labelled = labelled.union(rest).distinct()
    labelled = labelled.persist()
    sizes = labelled.groupBy("cluster_id").count().where(F.col("count") >= least).drop("count")
    return labelled.join(sizes, "cluster_id").select(F.col("id").alias(key), "cluster_id")


def describe_clusters(df: DataFrame, found: DataFrame, key: str, parts: list[tuple[str, int, float]], typical: int = 3) -> DataFrame:
    """One row per cluster: cluster_id, members, radius (root mean square distance from the mean) and the keys of the
    ``typical`` members nearest to the mean."""
    factors = [f for _, n, f in parts for _ in range(n)]
    d = len(factors)
    p = [f"p{i}" for i in range(d)]
    pts = points(df, key, parts).groupBy("id").agg(*[F.first(c).alias(c) for c in p])
    member = found.select(F.col(key).alias("id"), "cluster_id").join(pts, "id")
    centre = member.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), *[F.avg(F.col(c).cast("double") * f).alias(f"m{c}") for c, f in zip(p, factors)])
    far = sum(((F.col(c).cast("double") * f - F.col(f"m{c}")) ** 2 for c, f in zip(p, factors)), F.lit(0.0))
    return _nearest(member.join(centre, "cluster_id").withColumn("far", far), "cluster_id", typical)


def _nearest(rows: DataFrame, group: str, typical: int) -> DataFrame:
    """Size, radius and nearest members of each group; the ranking keeps ``typical`` rows per group before it shuffles."""
    from pyspark.sql import Window

    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.sqrt(F.avg("far")).alias("radius"))
    top = (
        rows.select(group, "id", "far")
        .withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("far", "id")))
        .where(F.col("n") <= typical)
        .groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("t"))
        .select(group, F.col("t.id").alias("typical"))
    )
    return sums.join(top, group)


def _sums(one: DataFrame, names: list[str], matrix, tree: Tree, planes: dict, squares: bool) -> dict:
    """{(leaf, side): rows, sums of their offsets from the plane's point, of the products of these, and the largest square distance}: of all
    rows in the leaves of ``planes`` (leaf: point, direction), by the side of the plane that they lie on. A task sends one row for each."""
    d = len(names)

    def add(batches):
        total = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b)
            _, at, _ = _ordered(*tree.leaves(x))
            for leaf in np.intersect1d(at, list(planes)).tolist():
                point, w = planes[leaf]
                o = x[at == leaf] - point
                side = o @ w > 0
                for which in (False, True):
                    p = o[side == which]
                    if len(p):
                        q = (p * p).sum(1).max()
                        v = np.concatenate([[len(p)], p.sum(0), (p.T @ p).ravel() if squares else []])
                        had = total.get((leaf, which))
                        total[leaf, which] = (v, q) if had is None else (had[0] + v, max(had[1], q))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total]), pa.array([v.tolist() for v, _ in total.values()], pa.list_(pa.float64())), pa.array([float(q) for _, q in total.values()])], names=["leaf", "side", "v", "q"])

    out = {}
    for r in one.select(*names).mapInArrow(add, "leaf int, side boolean, v array<double>, q double").collect():
        had = out.get((r["leaf"], r["side"]), (0, 0.0))
        out[r["leaf"], r["side"]] = (had[0] + np.array(r["v"]), max(had[1], r["q"]))
    return {k: (int(v[0]), v[1:d + 1], v[d + 1:].reshape(d, d) if squares else None, q) for k, (v, q) in out.items()}


def _ordered(row: np.ndarray, leaf: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.argsort(row, kind="stable")
    return row[by], leaf[by], home[by]


def _top_tree(one: DataFrame, names: list[str], matrix, most: float, radius: float, rounds: int = 6) -> tuple[Tree, dict]:
    """The upper part of the tree that ``fit_tree`` grows on all rows, worked out by sums over them, down to nodes of at most ``most``
    rows; and {leaf: its mean} of the larger ones that are not split, as they lie within ``radius`` of it or are all equal."""
    d = len(names)
    tree, whole, todo, before = Tree(np.zeros((0, d)), np.zeros(0), [], [], np.zeros((1, d))), {}, [0], {}
    while todo:
        got = _sums(one, names, matrix, tree, {k: (np.zeros(d), np.zeros(d)) for k in todo}, False)
        big = {k: got[k, False][1] / got[k, False][0] for k in todo if (k, False) in got and got[k, False][0] > most}
        # about the mean, now that it is known: the direction of the largest spread
        about = _sums(one, names, matrix, tree, {k: (m, np.zeros(d)) for k, m in big.items()}, True) if big else {}
        planes, last, done = {}, {}, {}
        for k, m in big.items():
            n, _, squares, q = about[k, False]
            w = power_direction(squares) if q > radius * radius and n != before.get(k) else None
            if w is None:
                whole[k] = m
            else:
                planes[k] = (m, w)
        for turn in range(rounds + 1):
            if not planes:
                break
            halves = _sums(one, names, matrix, tree, planes, False)
            for k in list(planes):
                if (k, False) not in halves or (k, True) not in halves:
                    del planes[k]
                    whole[k] = big[k]
                    continue
                n = (halves[k, False][0], halves[k, True][0])
                a, b = (planes[k][0] + halves[k, s][1] / halves[k, s][0] for s in (False, True))
                if turn == rounds or last.get(k) == n and np.allclose(done[k], (a, b), rtol=1e-12, atol=0):
                    del planes[k]
                else:
                    planes[k] = ((a + b) / 2, b - a)
                last[k], done[k] = n, (a, b)
        split = {k: ab for k, ab in done.items() if k not in whole}
        tree, todo = tree.grown(split)
        before = dict(zip(todo, (about[k, False][0] for k in split for _ in range(2))))
    return tree, whole


def bisecting_leaves(df: DataFrame, key: str, parts: list[tuple[str, int, float]], leaf_rows: int = LEAF_ROWS, task_rows: int = TASK_ROWS, compact: float = 0.0, typical: int = 3) -> DataFrame:
    """The leaves of the bisecting k-means tree over all records: leaf, members, radius about the leaf's mean, and its most typical records.
    Repeated rows count once. Nodes of more than ``task_rows`` records are split by sums over the cluster, each of the others by one
    task, down to the leaves. Numbers beyond the 1st and 99th percentiles by more than their span count as that."""
    from pyspark.sql import Window

    factors = np.array([f for _, n, f in parts for _ in range(n)], dtype=np.float64)
    d = len(factors)
    names = [f"p{i}" for i in range(d)]
    one = points(df, key, parts).groupBy("id").agg(*[F.first(c).alias(c) for c in names]).persist()
    ends = grouped_ranks(one.select(F.lit(0).alias("g"), *names), ["g"], names, lambda n: (F.floor((n - 1) * 0.01), F.ceil((n - 1) * 0.99)), every=False).first()
    low, high = (np.array([ends[f"{c}_{e}"] if ends else 0.0 for c in names]) * factors for e in ("low", "high"))
    low, high = np.minimum(low, high), np.maximum(low, high)
    reach = np.maximum(high - low, 1e-6)
    low, high = low - reach, high + reach
    matrix = lambda b: np.clip(_matrix(b, d, factors), low, high)
    most = max(8.0, leaf_rows)
    tree, whole = _top_tree(one, names, matrix, max(task_rows, most), compact)

    def walk(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                _, node, _ = _ordered(*tree.leaves(x))
                far = np.full(len(x), np.nan)
                for k in np.intersect1d(node, list(whole)).tolist():
                    far[node == k] = ((x[node == k] - whole[k]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node.astype(np.int32)), pa.array(far)], names=["id", *names, "node", "far"])

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        x = np.clip(np.stack([t.column(c).to_numpy() for c in names], 1).astype(np.float64) * factors, low, high)
        part = fit_tree(x, most, compact)
        _, leaf, _ = _ordered(*part.leaves(x))
        return pa.table({"node": t.column("node"), "leaf": leaf, "id": t.column("id"), "far": ((x - part.centres[leaf]) ** 2).sum(1)})

    placed = one.select("id", *names).mapInArrow(walk, f"id bigint, {', '.join(f'{c} float' for c in names)}, node int, far double")
    rows = placed.where(F.isnan("far")).select("id", *names, "node").groupBy("node").applyInArrow(finish, "node int, leaf bigint, id bigint, far double")
    rows = rows.union(placed.where(~F.isnan("far")).select("node", F.lit(0).cast("bigint"), "id", "far")) if whole else rows
    found = _nearest(rows.select((F.col("node").cast("bigint") * (1 << 32) + F.col("leaf")).alias("_leaf"), "id", "far"), "_leaf", typical)
    # one row for each leaf, some 500 for a million records
    return found.select((F.row_number().over(Window.orderBy("_leaf")) - 1).alias("leaf"), "members", "radius", "typical")
