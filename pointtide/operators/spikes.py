"""Implausible readings of measured columns, judged against what is usual at their source (problem 6).

Readings become logarithms over their source's exact median. The largest and the least of each day and hour of the source form two
daily profile matrices; robust principal components split each into low-rank normal behaviour and sparse spikes. The sparse parts
name the cells (days and hours) in which rows are read again, and there a reading beyond the stated factor of the source's median
is a case. A cell that isn't named holds none: its extreme is the sum of the sparse part, there at most NEAR of log(factor), and of
what is left, there at most the rest of log(factor); a cell in which what is left is beyond that is named too. Impossible values and
constant runs are tested separately.

Defined results: null values are no cases; repeated rows count once; a source without possible readings has no spikes;
non-finite or out-of-range numbers are cases of their own and never enter a median; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import cut, finite, join_null_safe
from .quantile import grouped_median

__all__ = ["robust_components", "named_cells", "spikes", "with_runs", "constant_runs", "faulty_readings"]

SLOTS = 24
#: Part of log(factor) that the sparse part of a cell must exceed to name it.
NEAR = 0.25
BROADCAST_ROWS = 100_000
#: Rows of an ordering that share one window task, and profile cells that share one decomposition task.
BLOCK = 8192
CELLS = 20_000
#: The fields, by number.
FIELDS = ["splats.positions", "splats.scales", "trajectories.positions", "chunk_groups.trajectory_max"]


def robust_components(m: np.ndarray, rounds: int = 60, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse parts of each matrix of the stack m (matrices x rows x columns) by principal component pursuit:
    alternating singular value and entry shrinkage under an augmented Lagrangian."""
    n1, n2 = m.shape[1:]
    lam = 1 / math.sqrt(max(n1, n2))
    norm = np.maximum(np.sqrt((m**2).sum((1, 2), keepdims=True)), 1e-12)
    top = np.maximum(np.linalg.norm(m, 2, axis=(1, 2))[:, None, None], 1e-12)
    y = m / np.maximum(top, np.abs(m).max((1, 2), keepdims=True) / lam)
    mu, sparse = 1.25 / top, np.zeros_like(m)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(m - sparse + y / mu, full_matrices=False)
        low = (u * np.maximum(s - 1 / mu[:, :, 0], 0)[:, None, :]) @ v
        t = m - low + y / mu
        sparse = np.sign(t) * np.maximum(np.abs(t) - lam / mu, 0)
        rest = m - low - sparse
        y = y + mu * rest
        mu = np.minimum(mu * 1.5, 1e7 / top)
        if (np.sqrt((rest**2).sum((1, 2), keepdims=True)) <= tol * norm).all():
            break
    return low, sparse


def _named(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """The cells of pdf (field, source, day, slot, high, low) that may hold a reading more than ``most`` from its source's median."""
    pdf = pdf.sort_values(["field", "source", "day", "slot"], ignore_index=True)
    group = pdf.groupby(["field", "source"], sort=False, dropna=False).ngroup().to_numpy()
    day = pdf.groupby(["field", "source", "day"], sort=False, dropna=False).ngroup().to_numpy()
    first = np.full(group.max() + 1, day.max() + 1)
    np.minimum.at(first, group, day)
    row = day - first[group]
    days = np.zeros(group.max() + 1, np.int64)
    np.maximum.at(days, group, row + 1)
    named = np.zeros(len(pdf), bool)
    for n in np.unique(days):
        mine = np.flatnonzero(days[group] == n)
        which, at = np.unique(group[mine], return_inverse=True)
        where = at, row[mine], pdf.slot.to_numpy()[mine]
        for side in (pdf.high.to_numpy()[mine], -pdf.low.to_numpy()[mine]):
            m = np.zeros((len(which), n, SLOTS))  # a cell without readings is at the source's median
            m[where] = np.clip(side, -3 * most, 3 * most)
            _, sparse = robust_components(m)
            named[mine] |= (sparse[where] > most * NEAR) | (m[where] - sparse[where] > most * (1 - NEAR) * (1 - 1e-9))
    return pdf.loc[named, ["field", "source", "day", "slot"]]


def named_cells(cells: DataFrame, factor: float) -> DataFrame:
    """(field, source, day, slot) of the ``cells`` (those, high, low: the extreme logarithms) in which rows are to be read."""
    parts = max(16, cells.count() // CELLS + 1)
    part = F.pmod(F.xxhash64("field", "source"), F.lit(parts)).alias("part")
    most = math.log(factor)
    return cells.groupBy(part).applyInPandas(lambda p: _named(p, most), "field int, source bigint, day date, slot int")


def _beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a small table, which is sent to them if it is small indeed."""
    few = cut(few)
    return join_null_safe(rows, few, keys, broadcast=few.count() <= BROADCAST_ROWS)


def spikes(readings: DataFrame, factor: float) -> DataFrame:
    """(field, key) of the spikes among ``readings`` (field, source, key, day, slot, reading, both): reading over ``factor`` times the
    median of its field and source or, where ``both``, under the factor-th part of it."""
    readings = readings.where(F.col("reading").isNotNull()).persist()
    medians = grouped_median(readings, ["field", "source"], ["reading"], every=False).withColumnRenamed("reading", "usual")
    rows = _beside(readings, medians, ["field", "source"])
    log = F.when((F.col("usual") > 0) & (F.col("reading") > 0), F.log(F.col("reading") / F.col("usual")))
    # without positive numbers on both sides there is no logarithm; such a reading is as far off as can be
    off = F.coalesce(log, F.when(F.col("reading") == F.col("usual"), 0.0).when(F.col("reading") > F.col("usual"), 99.0).otherwise(-99.0))
    low = F.coalesce(F.min(F.when(F.col("both"), off)), F.lit(0.0))
    cells = rows.groupBy("field", "source", "day", "slot").agg(F.max(off).alias("high"), low.alias("low"))
    read = _beside(rows, named_cells(cut(cells), factor), ["field", "source", "day", "slot"])
    over = F.col("reading") > F.col("usual") * factor
    under = F.col("both") & (F.col("reading") < F.col("usual") / factor)
    return read.where(over | under).select("field", "key")


def with_runs(df: DataFrame, groups: list[str], order: str, values: list[str], least: int, key: str) -> DataFrame:
    """The rows of ``df``, once per ``key``, with ``stuck``: whether the row is in a run of at least ``least`` rows with equal, non-null
    ``values`` at consecutive integers of ``order`` within ``groups``.

    Windows are over blocks of the ordering that overlap by least - 1, so that a hot group is cut up; repeated rows, whose groups and
    orders are equal, meet in the same block, and one shuffle serves them and the windows."""
    o, edge = F.col(order).cast("bigint"), least - 1
    at, block = F.pmod(o, F.lit(BLOCK)), F.floor(o / BLOCK).cast("bigint")
    # rows without a place in the order are spread
    home = F.coalesce(block, -1 - F.pmod(F.xxhash64(key), F.lit(1024)))
    other = F.when(at < edge, block - 1).when(at >= BLOCK - edge, block + 1)
    d = df.withColumn("_o", o).withColumn("_block", F.explode(F.array_compact(F.array(home, other)))).withColumn("_own", F.col("_block") == home)
    d = d.repartition(*groups, "_block").dropDuplicates([*groups, "_block", key])
    w = Window.partitionBy(*groups, "_block").orderBy("_o")
    same = F.col("_o") == F.lag("_o").over(w) + 1
    for v in values:
        same = same & (F.col(v) == F.lag(v).over(w))
    d = d.withColumn("_same", F.when(F.coalesce(same, F.lit(False)), 1).otherwise(0))
    d = d.withColumn("_ends", F.sum("_same").over(w.rowsBetween(-(edge - 1), 0)) == edge)
    return d.withColumn("stuck", F.max("_ends").over(w.rowsBetween(0, edge))).where("_own").select(*df.columns, "stuck")


def constant_runs(df: DataFrame, groups: list[str], order: str, values: list[str], least: int, key: str) -> DataFrame:
    """key of the rows that ``with_runs`` finds stuck."""
    return with_runs(df.select(*groups, order, *values, key), groups, order, values, least, key).where("stuck").select(key)


def _all(cols: list[Column], op) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = op(out, c)
    return out


def _when(at: str) -> list[Column]:
    return [F.to_date(at).alias("day"), F.coalesce(F.hour(at), F.lit(0)).alias("slot")]


def _reading(rows: DataFrame, field: int, reading: Column, both: bool) -> DataFrame:
    return rows.select(F.lit(field).alias("field"), "source", "key", "day", "slot", reading.alias("reading"), F.lit(both).alias("both"))


def _splats(df: DataFrame):
    part = lambda name, i: F.when(F.size(name) == 3, F.col(name)[i]).cast("float")
    names = ["x", "y", "z"], ["s0", "s1", "s2"]
    rows = df.where("splat_id is not null").select(
        F.col("splat_id").cast("bigint").alias("key"), F.col("capture_id").cast("bigint").alias("source"), "chunk_id", "record_id", *_when("observed_at"),
        *[part("positions", i).alias(n) for i, n in enumerate(names[0])], *[part("scales", i).alias(n) for i, n in enumerate(names[1])],
        (F.size("positions") == 3).alias("has_p"), (F.size("scales") == 3).alias("has_s"),
    )
    rows = with_runs(rows, ["chunk_id"], "record_id", names[1], 6, "key").drop("record_id").persist()
    p_ok = _all([finite(F.col(n)) for n in names[0]], lambda a, b: a & b)
    s_ok = _all([finite(F.col(n)) & (F.col(n) > 0) for n in names[1]], lambda a, b: a & b)
    good = rows.where("has_p").where(p_ok)
    middle = grouped_median(good, ["chunk_id"], names[0], every=False).select("chunk_id", *[F.col(n).alias(f"m{n}") for n in names[0]])
    far = F.sqrt(_all([(F.col(n).cast("double") - F.col(f"m{n}")) ** 2 for n in names[0]], lambda a, b: a + b))
    positions = _reading(_beside(good, middle, ["chunk_id"]), 0, far, False)
    largest = F.greatest(*[F.col(n).cast("double") for n in names[1]])
    scales = _reading(rows.where("has_s").where(s_ok), 1, largest, True)
    bad_p, bad_s = F.col("has_p") & ~p_ok, F.col("has_s") & (~s_ok | F.col("stuck"))
    broken = rows.where(bad_p | bad_s).select(F.explode(F.array_compact(F.array(F.when(bad_p, 0), F.when(bad_s, 1)))).alias("field"), "key")
    return positions.union(scales), broken


def _trajectories(df: DataFrame):
    n = 8
    rows = (
        df.where((F.size("positions") == 3 * n) & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("bigint").alias("key"), F.col("capture_id").cast("bigint").alias("source"), "positions", "ingested_at")
        .groupBy("key").agg(F.min("source").alias("source"), F.min("ingested_at").alias("at"), F.min("positions").alias("p"))
    )
    whole = F.forall("p", lambda v: finite(v))
    sample = lambda i, k: F.col("p")[3 * i + k].cast("double")
    middle = []
    for k in range(3):
        s = F.sort_array(F.array(*[sample(i, k) for i in range(n)]))
        middle.append((s[n // 2 - 1] + s[n // 2]) / 2)
    rows = rows.withColumn("whole", whole).select("*", *[m.alias(f"m{k}") for k, m in enumerate(middle)])
    far = F.greatest(*[F.sqrt(_all([(sample(i, k) - F.col(f"m{k}")) ** 2 for k in range(3)], lambda a, b: a + b)) for i in range(n)])
    equal = [None, *[_all([F.col("p")[3 * i + k] == F.col("p")[3 * i - 3 + k] for k in range(3)], lambda a, b: a & b) for i in range(1, n)]]
    held = _all([_all([F.coalesce(equal[j], F.lit(False)) for j in range(i, i + 4)], lambda a, b: a & b) for i in range(1, n - 3)], lambda a, b: a | b)
    bad = (~F.col("whole") & ~F.exists("p", lambda v: v.isNull())) | held
    rows = rows.select("key", "source", *_when("at"), "whole", F.when(F.col("whole"), far).alias("far"), bad.alias("bad")).persist()
    return _reading(rows.where("whole"), 2, F.col("far"), False), rows.where("bad").select(F.lit(2).alias("field"), "key")


def _blocks(df: DataFrame):
    rows = (
        df.where("block_id is not null")
        .select(F.col("block_id").cast("bigint").alias("key"), F.col("capture_id").cast("bigint").alias("source"), "chunk_index", "group_no", F.col("trajectory_min").alias("least"), F.col("trajectory_max").alias("v"), "ingested_at")
        .groupBy("key").agg(*[F.min(c).alias(c) for c in ("source", "chunk_index", "group_no", "least", "v")], F.min("ingested_at").alias("at"))
    )
    impossible = ~finite(F.col("v")) | F.coalesce(F.col("v") < F.col("least"), F.lit(False))
    rows = rows.select("key", "source", "chunk_index", "group_no", *_when("at"), "v", impossible.alias("impossible"))
    rows = with_runs(rows, ["source", "group_no"], "chunk_index", ["v"], 4, "key").where("v is not null").persist()
    return _reading(rows.where("not impossible"), 3, F.col("v"), True), rows.where("impossible or stuck").select(F.lit(3).alias("field"), "key")


def faulty_readings(splats: DataFrame, trajectories: DataFrame, chunk_groups: DataFrame, factor: float = 7.0) -> DataFrame:
    """(table_name, row_key, field_name) of every faulty reading of the three tables."""
    found = [_splats(splats), _trajectories(trajectories), _blocks(chunk_groups)]
    cases = spikes(found[0][0].union(found[1][0]).union(found[2][0]), factor)
    for _, more in found:
        cases = cases.union(more)
    name = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("field") + 1)
    part = lambda i: F.split_part(name, F.lit("."), F.lit(i))
    return cases.distinct().select(part(1).alias("table_name"), F.col("key").alias("row_key"), part(2).alias("field_name"))
