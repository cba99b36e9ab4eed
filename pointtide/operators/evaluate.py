"""Evaluation of coded records at an instant, fits of rigid motions and dictionaries, and linear algebra in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import nlerp, quat_multiply, quat_normalise

__all__ = [
    "sample_at", "residual_positions", "cumulative_turns", "evaluate_frame", "rigid_fit", "rigid_fits", "leave_one_out", "covariance_bake", "covariance_of", "harmonics_rotation", "rotate_harmonics", "harmonics_projection", "project_harmonics",
    "median_cut", "polygon_contains", "capped_segments", "budget_segments", "greedy_cover", "infer_timebase", "morph_timing", "motion_atoms", "unit_atoms",
]


def sample_at(samples: Column, count: int, t: Column) -> list[Column]:
    """Coordinates at normalised time t (0 to 1) of a flat array of ``count`` samples x, y, z, linear between neighbours."""
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (count - 1)
    i = F.least(F.floor(at), F.lit(count - 2)).cast("int")
    a = at - i
    return [(F.lit(1.0) - a) * F.get(samples, i * 3 + k).cast("double") + a * F.get(samples, i * 3 + 3 + k).cast("double") for k in range(3)]


def residual_positions(records: DataFrame, dictionary: DataFrame, alpha: float, sample: int) -> DataFrame:
    """(record columns, x, y, z): base plus the weighted dictionary entries of each record, interpolated between two samples.

    ``records``: chunk_id, record_id, base array<double>, terms array<struct<idx int, weight double>>; ``dictionary``: chunk_id,
    entry, sample, xyz. A record without terms stays at its base; a term without an entry adds nothing."""
    a = dictionary.where(F.col("sample") == sample).select("chunk_id", "entry", F.col("xyz").alias("_a"))
    b = dictionary.where(F.col("sample") == sample + 1).select("chunk_id", "entry", F.col("xyz").alias("_b"))
    both = a.join(b, ["chunk_id", "entry"], "left").select("chunk_id", F.col("entry").alias("_e"), *[((F.lit(1.0) - alpha) * F.col("_a")[k] + F.coalesce(F.col("_b")[k], F.col("_a")[k]) * alpha).alias(f"_d{k}") for k in range(3)])
    term = records.select("chunk_id", "record_id", F.explode("terms").alias("_t")).select("chunk_id", "record_id", F.col("_t.idx").alias("_e"), F.col("_t.weight").alias("_w"))
    moved = term.join(both, ["chunk_id", "_e"]).groupBy("chunk_id", "record_id").agg(*[F.sum(F.col("_w") * F.col(f"_d{k}")).alias(f"_m{k}") for k in range(3)])
    out = records.join(moved, ["chunk_id", "record_id"], "left")
    return out.select(*records.columns, *[(F.col("base")[k] + F.coalesce(f"_m{k}", F.lit(0.0))).alias(n) for k, n in enumerate("xyz")])


def cumulative_turns(deltas: DataFrame, groups: list[str], order: str, parts: list[str]) -> DataFrame:
    """``deltas`` with running sums of ``parts`` along the ordering, as rotation dictionaries store their steps."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumns({f"{p}_sum": F.sum(p).over(w) for p in parts})


def evaluate_frame(records: DataFrame, motion: DataFrame, alpha: float, sample: int, c0: float) -> DataFrame:
    """Display attributes at an instant. ``records`` has chunk_id, record_id, life_start, life_end, x, y, z, qa, qb (quaternion at the
    two samples), opacity_stages array<double>, opacity_code, colour_base and colour_stages arrays; ``motion`` one row per chunk of
    translation t, rotation q and scale s. The motion joins by chunk; chunks without one stay where they are."""
    q = nlerp([F.col("qa")[k] for k in range(4)], [F.col("qb")[k] for k in range(4)], F.lit(alpha))
    j = records.where((F.col("life_start") <= sample) & (F.col("life_end") >= sample + 1)).join(motion, "chunk_id", "left")
    s = F.coalesce("s", F.lit(1.0))
    m = [F.coalesce(F.col("q")[k], F.lit(1.0 if k == 3 else 0.0)) for k in range(4)]
    from ..functions.geometry import quat_rotate

    p = quat_rotate(m, [F.col(a) for a in "xyz"])
    o = F.aggregate("opacity_stages", F.lit(0.0), lambda a, v: a + v)
    colour = [F.lit(0.5) + (F.col("colour_base")[k] + F.aggregate("colour_stages", F.lit(0.0), lambda a, v: a + v[k])) * c0 for k in range(3)]
    # the interpolated rotation, a unit already, is worked out once
    turned = F.transform(F.array(F.array(*q)), lambda u: F.array(*quat_multiply(m, [u[k] for k in range(4)])))[0]
    turned = [turned[k] for k in range(4)]
    return j.select(
        "chunk_id", "record_id", *[(p[k] * s + F.coalesce(F.col("t")[k], F.lit(0.0))).alias(n) for k, n in enumerate("xyz")], *[c.alias(n) for c, n in zip(turned, ("qx", "qy", "qz", "qw"))],
        (F.least(F.lit(1.0), F.greatest(F.lit(0.0), o)) * F.pow(F.lit(2.0), -F.col("opacity_code") / 16.0)).alias("o"), *[c.alias(n) for c, n in zip(colour, "rgb")],
    )


def rigid_fit(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rotation r and translation t that bring the points a nearest to b, by weighted least squares without reflection."""
    w = np.ones(len(a)) if w is None else w
    ca, cb = (w[:, None] * a).sum(0) / w.sum(), (w[:, None] * b).sum(0) / w.sum()
    u, _, v = np.linalg.svd((w[:, None] * (a - ca)).T @ (b - cb))
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(v.T @ u.T)) or 1.0])
    r = v.T @ turn @ u.T
    return r, cb - r @ ca


def rigid_fits(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, r, t, error, shifted, rotation) of the rotation r (nine numbers) and shift t that bring a0..a2 nearest to b0..b2: root mean
    square of what is left, of what a shift alone would leave, and whether r is a rotation. A group's sums are what travels, in two
    passes, so that large coordinates lose nothing."""
    mid = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{s}{k}").alias(f"m{s}{k}") for s in "ab" for k in range(3)])
    off = df.join(mid, groups).select(*groups, "n", *[f"m{s}{k}" for s in "ab" for k in range(3)], *[(F.col(f"{s}{k}") - F.col(f"m{s}{k}")).alias(f"d{s}{k}") for s in "ab" for k in range(3)])
    sums = [F.sum(F.col(f"da{i}") * F.col(f"db{j}")).alias(f"h{i}{j}") for i in range(3) for j in range(3)]
    size = lambda s: F.sum(sum((F.col(f"d{s}{k}") ** 2 for k in range(3)), F.lit(0.0))).alias(f"q{s}")
    g = off.groupBy(*groups, "n", *[f"m{s}{k}" for s in "ab" for k in range(3)]).agg(*sums, size("a"), size("b"))
    kinds = dict(g.dtypes)

    def fit(batches):
        for b in batches:
            get = lambda *names: np.stack([b.column(c).to_numpy() for c in names], 1)
            h = get(*[f"h{i}{j}" for i in range(3) for j in range(3)]).reshape(-1, 3, 3)
            u, s, v = np.linalg.svd(h)
            sign = np.sign(np.linalg.det(u @ v))
            s[:, 2] *= np.where(sign == 0, 1, sign)
            d = np.repeat(np.eye(3)[None], len(h), 0)
            d[:, 2, 2] = np.where(sign == 0, 1, sign)
            r = v.transpose(0, 2, 1) @ d @ u.transpose(0, 2, 1)
            n, qa, qb = get("n")[:, 0], get("qa")[:, 0], get("qb")[:, 0]
            t = get("mb0", "mb1", "mb2") - np.einsum("nij,nj->ni", r, get("ma0", "ma1", "ma2"))
            error = np.sqrt(np.maximum(qa + qb - 2 * s.sum(1), 0) / n)
            shifted = np.sqrt(np.maximum(qa + qb - 2 * np.trace(h, axis1=1, axis2=2), 0) / n)
            turn = (np.abs(r @ r.transpose(0, 2, 1) - np.eye(3)).max((1, 2)) < 1e-9) & (np.linalg.det(r) > 0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*groups, "n")], pa.array(list(r.reshape(-1, 9))), pa.array(list(t)), pa.array(error), pa.array(shifted), pa.array(turn)], names=[*groups, "n", "r", "t", "error", "shifted", "rotation"])

    return g.mapInArrow(fit, ", ".join(f"{c} {kinds[c]}" for c in (*groups, "n")) + ", r array<double>, t array<double>, error double, shifted double, rotation boolean")


def leave_one_out(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far each marker lies from where the fit of the others puts it."""
    out = np.zeros(len(a))
    for i in range(len(a)):
        rest = np.arange(len(a)) != i
        r, t = rigid_fit(a[rest], b[rest])
        out[i] = np.linalg.norm(r @ a[i] + t - b[i])
    return out


def covariance_bake(df: DataFrame, m: np.ndarray) -> DataFrame:
    """``df`` (qx..qw, sx..sz) with sizes and orientation of each record's ellipsoid under the 3x3 map m, from the eigenvectors of its
    covariance; sizes fall from first to last, and the quaternion's w is not negative."""
    cols = ["qx", "qy", "qz", "qw", "sx", "sy", "sz"]
    names = df.columns

    def bake(batches):
        for b in batches:
            q = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols[:4]], 1)
            s = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols[4:]], 1)
            n = np.linalg.norm(q, axis=1, keepdims=True)
            q = np.where(n > 0, q / np.where(n > 0, n, 1), [0, 0, 0, 1])
            a = m @ (_rotations(q) * s[:, None, :])
            val, vec = np.linalg.eigh(a @ a.transpose(0, 2, 1))
            val, vec = val[:, ::-1], vec[:, :, ::-1].copy()
            flip = np.linalg.det(vec) < 0
            vec[flip, :, 2] *= -1
            q, s = _quaternions(vec), np.sqrt(np.maximum(val, 0))
            new = dict(zip(cols, [*q.T, *s.T]))
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else b.column(c) for c in names], names=names)

    return df.mapInArrow(bake, ", ".join(f"`{n}` {'double' if n in cols else t}" for n, t in df.dtypes))


def covariance_of(parts: list[Column], m: np.ndarray) -> list[Column]:
    """xx, xy, xz, yy, yz, zz of the covariance of records (quaternion and sizes, as ``parts``) under the 3x3 map m. A record without
    orientation is unturned."""
    x, y, z, w = quat_normalise(parts[:4])
    r = [
        [F.lit(1.0) - (y * y + z * z) * 2, (x * y - z * w) * 2, (x * z + y * w) * 2], [(x * y + z * w) * 2, F.lit(1.0) - (x * x + z * z) * 2, (y * z - x * w) * 2],
        [(x * z - y * w) * 2, (y * z + x * w) * 2, F.lit(1.0) - (x * x + y * y) * 2],
    ]
    a = [[sum((r[j][k] * float(m[i, j]) for j in range(3)), F.lit(0.0)) * parts[4 + k] for k in range(3)] for i in range(3)]
    return [sum((a[i][k] * a[j][k] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(i, 3)]


def _rotations(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q.T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3, 3)


def _quaternions(r: np.ndarray) -> np.ndarray:
    """Unit quaternions of rotation matrices, through the eigenvector of the largest of four scores."""
    t = np.stack([1 + r[:, 0, 0] - r[:, 1, 1] - r[:, 2, 2], 1 - r[:, 0, 0] + r[:, 1, 1] - r[:, 2, 2], 1 - r[:, 0, 0] - r[:, 1, 1] + r[:, 2, 2], 1 + r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]], 1)
    x, y, z = r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]
    xy, xz, yz = r[:, 0, 1] + r[:, 1, 0], r[:, 0, 2] + r[:, 2, 0], r[:, 1, 2] + r[:, 2, 1]
    rows = np.stack([np.stack([t[:, 0], xy, xz, x], 1), np.stack([xy, t[:, 1], yz, y], 1), np.stack([xz, yz, t[:, 2], z], 1), np.stack([x, y, z, t[:, 3]], 1)], 1)
    q = rows[np.arange(len(r)), t.argmax(1)]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(q[:, 3:] < 0, -q, q)


def _basis(v: np.ndarray, band: int) -> np.ndarray:
    """Real spherical harmonics of one band (1 to 3) at unit vectors, up to a constant for each, which cancels in rotations of
    orthonormal bases."""
    x, y, z = v.T
    if band == 1:
        return np.stack([y, z, x], 1) * math.sqrt(3 / (4 * math.pi))
    if band == 2:
        k = math.sqrt(15 / (4 * math.pi))
        return np.stack([k * x * y, k * y * z, math.sqrt(5 / (16 * math.pi)) * (3 * z * z - 1), k * x * z, k / 2 * (x * x - y * y)], 1)
    a, b, c, e = math.sqrt(35 / (32 * math.pi)), math.sqrt(105 / (4 * math.pi)), math.sqrt(21 / (32 * math.pi)), math.sqrt(7 / (16 * math.pi))
    return np.stack([a * y * (3 * x * x - y * y), b * x * y * z, c * y * (5 * z * z - 1), e * z * (5 * z * z - 3), c * x * (5 * z * z - 1), b / 2 * z * (x * x - y * y), a * x * (x * x - 3 * y * y)], 1)


def harmonics_rotation(r: np.ndarray, band: int) -> np.ndarray:
    """The matrix that turns a band's coefficients with the rotation r, by least squares over directions spread on the sphere."""
    i = np.arange(64) + 0.5
    z = 1 - 2 * i / 64
    a = math.pi * (1 + math.sqrt(5)) * i
    v = np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], 1)
    return np.linalg.lstsq(_basis(v, band), _basis(v @ r, band), rcond=None)[0]


def harmonics_projection(m: np.ndarray, rows: int = 24, columns: int = 48) -> np.ndarray:
    """The 15 by 15 matrix that takes harmonics of degree 1 to 3 to those nearest to the same light seen through the 3x3 map m, by
    quadrature over directions (Gauss's points in height, even ones around)."""
    z, w = np.polynomial.legendre.leggauss(rows)
    a = (np.arange(columns) + 0.5) * 2 * math.pi / columns
    r = np.sqrt(1 - z * z)
    v = np.stack([np.outer(r, np.cos(a)), np.outer(r, np.sin(a)), np.repeat(z[:, None], columns, 1)], 2).reshape(-1, 3)
    w = np.repeat(w, columns) * 2 * math.pi / columns
    u = v @ np.linalg.inv(m).T
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    every = lambda x: np.concatenate([_basis(x, b) for b in (1, 2, 3)], 1)
    return every(v).T @ (w[:, None] * every(u))


def project_harmonics(coefficients: Column, m: np.ndarray) -> Column:
    """An array of 15 coefficients under the 3x3 map m; the matrix is a literal of the plan."""
    p = harmonics_projection(m)
    return F.array(*[sum((F.get(coefficients, F.lit(j)) * float(p[i, j]) for j in range(15)), F.lit(0.0)) for i in range(15)])


def rotate_harmonics(coefficients: Column, r: np.ndarray) -> Column:
    """An array of 3, 8 or 15 coefficients turned with r; the matrices are literals of the plan."""
    out, at = [], 0
    for band in (1, 2, 3):
        m = harmonics_rotation(r, band)
        n = 2 * band + 1
        part = [sum((F.get(coefficients, F.lit(at + j)) * float(m[i, j]) for j in range(n)), F.lit(0.0)) for i in range(n)]
        out.append(F.when(F.size(coefficients) >= at + n, F.array(*part)).otherwise(F.array().cast("array<double>")))
        at += n
    return F.concat(*out)


def median_cut(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(palette, code of each row): cells split at the median of their widest-varying axis, that of the largest variance first."""
    cells = [np.arange(len(x))]
    while len(cells) < size:
        spread = [(x[c].var(0) * len(c)).max() if len(c) > 1 else 0 for c in cells]
        k = int(np.argmax(spread))
        if spread[k] <= 0:
            break
        c = cells.pop(k)
        axis = int(np.argmax(x[c].var(0)))
        order = c[np.argsort(x[c][:, axis], kind="stable")]
        cells[k:k] = [order[: len(c) // 2], order[len(c) // 2:]]
    code = np.empty(len(x), np.int64)
    for i, c in enumerate(cells):
        code[c] = i
    return np.array([x[c].mean(0) for c in cells]), code


def polygon_contains(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a polygon, by the parity of the edges that a ray to the right crosses."""
    odd = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 == y1:
            continue
        crosses = ((y >= min(y0, y1)) & (y < max(y0, y1))) & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0)
        odd = odd + crosses.cast("int")
    return odd % 2 == 1


def capped_segments(df: DataFrame, groups: list[str], order: str, mark: str, most: int) -> DataFrame:
    """(groups, first, last, n): consecutive rows, cut where ``mark`` changes and after ``most`` rows. The cap counts from the last cut,
    so that within a run of one mark the cuts lie at multiples of it: no state has to be carried along."""
    d = df.select(*groups, F.col(order).alias("_o"), F.col(mark).alias("_m"))
    w = Window.partitionBy(*groups).orderBy("_o")
    d = d.withColumn("_f", F.when(F.row_number().over(w) == 1, 1).when(~F.col("_m").eqNullSafe(F.lag("_m").over(w)), 1).otherwise(0)).withColumn("_run", F.sum("_f").over(w))
    d = d.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(*groups, "_run").orderBy("_o")) - 1) / most))
    return d.groupBy(*groups, "_run", "_k").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("n")).drop("_run", "_k")


def budget_segments(df: DataFrame, groups: list[str], order: str, mark: str, work: str, most: int, budget: int) -> DataFrame:
    """(groups, first, last, n, total): consecutive rows, cut where ``mark`` changes, after ``most`` rows, and before the sum of ``work``
    passes ``budget``; a row over the budget stands alone. A cut depends on the one before, but never reaches past a change of the
    mark: each run of one mark is cut by itself, as a stream of its sorted rows."""
    d = df.select(*groups, F.col(order).cast("bigint").alias("_o"), F.col(mark).alias("_m"), F.col(work).cast("bigint").alias("_v"))
    w = Window.partitionBy(*groups).orderBy("_o")
    d = d.withColumn("_f", F.when(F.row_number().over(w) == 1, 1).when(~F.col("_m").eqNullSafe(F.lag("_m").over(w)), 1).otherwise(0)).withColumn("_run", F.sum("_f").over(w))
    kinds = dict(d.dtypes)

    def cuts(t: pa.Table) -> pa.Table:
        t = t.sort_by("_o")
        o, v = t.column("_o").to_numpy(), t.column("_v").to_numpy()
        upto, at, first = np.concatenate([[0], np.cumsum(v)]), 0, []
        while at < len(o):
            first.append(at)
            at = min(at + most, max(at + 1, int(np.searchsorted(upto, upto[at] + budget, side="right")) - 1), len(o))
        a = np.array(first)
        b = np.append(a[1:], len(o))
        return pa.table([*[pa.array([t.column(g)[0].as_py()] * len(a), t.column(g).type) for g in groups], o[a], o[b - 1], b - a, upto[b] - upto[a]], names=[*groups, "first", "last", "n", "total"])

    return d.groupBy(*groups, "_run").applyInArrow(cuts, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", first bigint, last bigint, n bigint, total bigint")


def greedy_cover(alive: np.ndarray) -> list[int]:
    """Samples that together see every record that is ever alive (records x samples): the middle one first, then always the one that
    sees most of what is left; ties to the earlier."""
    left = alive.any(1)
    out, k = [], alive.shape[1] // 2
    while left.any():
        seen = alive[:, k] & left
        if seen.any():
            out.append(k)
            left = left & ~alive[:, k]
        k = int((alive & left[:, None]).sum(0).argmax())
    return out


def infer_timebase(seconds: float, most: int = 120_000) -> tuple[int, int]:
    """The rational (numerator, denominator) of an interval: over 1 if that reproduces it, else over 1001, else the smallest that does."""
    if not seconds > 0:
        raise ValueError("an interval must be positive")
    for n in (1, 1001):
        d = round(n / seconds)
        if d >= 1 and abs(n / d - seconds) <= 1e-9 * seconds:
            return n, d
    from fractions import Fraction

    f = Fraction(seconds).limit_denominator(most)
    return f.numerator or 1, f.denominator


def morph_timing(seconds: float, fps: float, start: float, end: float) -> list[tuple[int, float]]:
    """(frame, fraction) of a loop morph: after the end where ``seconds`` is positive, over the last frames where it is negative."""
    first, last = round(start * fps), round(end * fps)
    n = max(1, round(abs(seconds) * fps))
    if seconds < 0:
        n = max(0, min(n, max(0, last - first - 1)))
        return [(last - n - 1 + k, k / (n + 1)) for k in range(1, n + 1)]
    return [(last + k, k / (n + 1)) for k in range(1, n + 1)]


def motion_atoms(df: DataFrame, group: str, key: str, samples: str, count: int) -> DataFrame:
    """(key, weight, error): every record's motion about its first sample, fitted by one shared atom of its group, the group's mean
    motion; error is the root mean square of what is left."""
    p = F.col(samples)
    n = 3 * (count - 1)
    motion = [(p[3 + i].cast("double") - p[i % 3].cast("double")).alias(f"m{i}") for i in range(n)]
    d = df.select(group, key, *motion)
    atom = d.groupBy(group).agg(*[F.avg(f"m{i}").alias(f"a{i}") for i in range(n)])
    j = d.join(atom, group)
    dot = sum((F.col(f"m{i}") * F.col(f"a{i}") for i in range(n)), F.lit(0.0))
    size = sum((F.col(f"a{i}") * F.col(f"a{i}") for i in range(n)), F.lit(0.0))
    j = j.withColumn("weight", F.when(size > 0, dot / size).otherwise(F.lit(0.0)))
    left = sum(((F.col(f"m{i}") - F.col("weight") * F.col(f"a{i}")) ** 2 for i in range(n)), F.lit(0.0))
    return j.select(key, "weight", F.sqrt(left / (count - 1)).alias("error"))


def unit_atoms(count: int) -> list[list[float]]:
    """Four motions of unit length over ``count`` samples, the first of which rests: an even push along x, y and z, and a swing to the
    side and back along x."""
    out = []
    for k in range(3):
        v = np.zeros((count - 1, 3))
        v[:, k] = np.arange(1, count)
        out.append(v)
    swing = np.zeros((count - 1, 3))
    swing[:, 0] = np.round(np.sin(np.arange(1, count) * 2 * math.pi / (count - 1)), 12)
    out.append(swing)
    return [(v / np.linalg.norm(v)).round(12).ravel().tolist() for v in out]
