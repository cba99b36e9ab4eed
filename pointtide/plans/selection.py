"""Queries on picked sets, colours and codebooks: brushes, morph sides, averages over frames, quantisers, invariants of fitted results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.colour import C0, auto_green_gain, despill, sigmoid
from ..functions.geometry import Transform
from ..operators import evaluate as E
from ..operators import profile as P
from ..operators.spatial import local_planes
from ..util import read
from .base import SPLATS, query, splats

_STROKES = (("replace", "x", -200.0, 150.0), ("add", "z", 1.5, 2.5), ("subtract", "y", 0.2, 0.6), ("add", "o", 0.9, 1.0))
#: Properties of a stored record, and what stands for one that a file lacks.
_STORED = ("opacity", "scale_0", "f_dc_0", "rot_0", "rot_1", "rot_2", "rot_3")


def brush_selection(spark, d):
    """Brush strokes in their order: each replaces the selection, adds to it or takes away from it."""
    s, picked = splats(spark, d, "", "x y z o"), None
    for op, axis, lo, hi in _STROKES:
        hit = s.where((F.col(axis) >= lo) & (F.col(axis) <= hi)).select("splat_id")
        picked = hit if op == "replace" or picked is None else picked.union(hit).distinct() if op == "add" else picked.join(hit, "splat_id", "left_anti")
    return picked


def morph_sides(spark, d):
    """The records at the start and at the end of their chunks as one frame: each side fades, and what can't be seen is dropped."""
    s = splats(spark, d, "o")
    side = lambda name, alive, fade: s.where(alive).select("splat_id", F.lit(name).alias("side"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("o"))) * fade, 6).alias("o"))
    both = side("end", "life_end > 20", 0.25).unionByName(side("start", "life_start <= 0", 0.75))
    return both.where(F.col("o") > 1 / 255)


def _cells(spark, d, names):
    """(sequence_id, frame_no, row_no, one column per name) by the headers as they stand, of files whose header has all of them."""
    f = read(spark, d, "ply_files").where("file_id is not null and sequence_id is not null and frame_no is not null").select("file_id", "sequence_id", "frame_no").distinct()
    f = f.groupBy("sequence_id", "frame_no").agg(F.min("file_id").alias("file_id"))
    p = read(spark, d, "ply_properties").where(F.col("prop_name").isin(*names)).groupBy("file_id").agg(*[F.min(F.when(F.col("prop_name") == n, F.col("ordinal"))).alias(f"_{n}") for n in names])
    for n in names:
        p = p.where(F.col(f"_{n}").isNotNull())
    v = read(spark, d, "ply_vertices").where("line is not null").select("file_id", "row_no", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("w"))
    v = v.join(f.join(p, "file_id"), "file_id")
    cell = lambda n: F.get("w", F.col(f"_{n}")).try_cast("double")
    return v.groupBy("sequence_id", "frame_no", "row_no").agg(*[F.min(cell(n)).alias(n) for n in names])


def ply_activated(spark, d):
    """Stored vertices as they are displayed: sigmoid opacity, exponential scale, colour from harmonics, the unit rotation's w."""
    c = _cells(spark, d, _STORED)
    n = F.sqrt(sum((F.col(f"rot_{i}") ** 2 for i in range(4)), F.lit(0.0)))
    o, s = sigmoid(F.col("opacity")), F.exp(F.col("scale_0"))
    return c.select("sequence_id", "frame_no", "row_no", F.round(o, 6).alias("o"), F.round(s, 6).alias("sx"), F.round(F.col("f_dc_0") * C0 + 0.5, 6).alias("r"), F.round(F.when(n > 0, F.col("rot_0") / n).otherwise(1.0), 6).alias("qw"), ((o > 1 / 255) & (s > 1e-4)).alias("active"))


def mean_harmonics(spark, d):
    """The mean of each vertex's first harmonics over the frames of its sequence, and the median of one of them."""
    c = _cells(spark, d, ("f_rest_0", "f_rest_1", "f_rest_2"))
    return c.groupBy("sequence_id", "row_no").agg(*[F.round(F.avg(f"f_rest_{i}"), 9).alias(f"m{i}") for i in range(3)], F.round(F.median("f_rest_0"), 6).alias("median"), F.count(F.lit(1)).alias("frames"))


def despill_tuned(spark, d):
    """Green spill removal with all of its settings."""
    out = despill(F.col("r"), F.col("g"), F.col("b"), 1.0, 0.8, 0.95, 0.9)
    return splats(spark, d, "r g b").select("splat_id", *[F.round(c, 6).alias(n) for c, n in zip(out, "rgb")])


def green_gains(spark, d):
    g = auto_green_gain(splats(spark, d, "r g b"), ["capture_id"])
    return g.select("capture_id", F.round("gain", 6).alias("gain"))


def palette_or_levels(spark, d):
    """A chunk's colours as they are where 48 hold them all, else at five levels a channel."""
    s = splats(spark, d, "r g b")
    p = P.palette(s, ["chunk_id"], ["r", "g", "b"], 48).select("chunk_id", "exact")
    level = lambda c: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) * 4 + 0.5) / 4
    j = s.join(p, "chunk_id").select("chunk_id", "exact", *[F.when(F.col("exact"), F.col(c)).otherwise(level(c)).alias(c) for c in "rgb"])
    return j.groupBy("chunk_id", "exact").agg(F.count_distinct("r", "g", "b").alias("colours"), F.round(F.min("g"), 6).alias("least"), F.round(F.max("g"), 6).alias("most"))


def lloyd_levels(spark, d):
    """Eight opacity levels per capture by thirty rounds of Lloyd's rule, from the quantiles on; values are counted in 4,096 steps first."""
    return P.lloyd_levels(splats(spark, d, "o").where("o >= 0 and o <= 1"), ["capture_id"], "o", 8, 30, 4096).select("capture_id", "level", F.round("value", 5).alias("value"), "n")


_M = Transform(rotation=(10, 20, 30), scale=(1.0, 2.0, 0.5)).matrix()[:3, :3]


def covariance_kept(spark, d):
    """Whether the baked sizes and rotations have the covariance that the map gives the record's own, within a billionth of its trace."""
    s = splats(spark, d, "qx qy qz qw sx sy sz").where("abs(sx) < 1e6 and abs(sy) < 1e6 and abs(sz) < 1e6")
    cols = ["qx", "qy", "qz", "qw", "sx", "sy", "sz"]
    baked = E.covariance_bake(s.select("splat_id", *cols, *[F.col(c).alias(f"o{c}") for c in cols]), _M)
    want, got = E.covariance_of([F.col(f"o{c}") for c in cols], _M), E.covariance_of([F.col(c) for c in cols], np.eye(3))
    trace = want[0] + want[3] + want[5]
    close = F.greatest(*[F.abs(a - b) for a, b in zip(want, got)]) <= trace * 1e-9 + 1e-300
    return baked.select("splat_id", close.alias("kept"), ((F.col("sx") >= F.col("sy")) & (F.col("sy") >= F.col("sz"))).alias("sorted"))


def planes_checked(spark, d):
    """Whether every normal of plane_normals is a unit and its flatness a part."""
    n = local_planes(splats(spark, d, "x y z o").where("abs(x) < 1e6 and abs(y) < 1e6 and abs(z) < 1e6"), ["chunk_id"], "splat_id")
    unit = F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) < 1e-9
    return n.select("splat_id", unit.alias("unit"), ((F.col("flatness") >= -1e-9) & (F.col("flatness") <= 1 + 1e-9)).alias("part"))


_F = (brush_selection, morph_sides, ply_activated, mean_harmonics, despill_tuned, green_gains, palette_or_levels, lloyd_levels, covariance_kept, planes_checked)
QUERIES = {f.__name__: f for f in _F}


def _brush_sql() -> str:
    out = ""
    for op, axis, lo, hi in _STROKES:
        hit = f"(SELECT splat_id FROM s WHERE {axis} >= {lo} AND {axis} <= {hi})"
        out = hit if op == "replace" or not out else f"({out} {'UNION' if op == 'add' else 'EXCEPT'} {hit})"
    return query(SPLATS("", "x y z o")) + f"SELECT splat_id FROM {out}"


def _cells_sql(names) -> str:
    at = ", ".join(f"min(ordinal) FILTER (prop_name = '{n}') AS _{n}" for n in names)
    return f"""WITH f AS (SELECT sequence_id, frame_no, min(file_id) AS file_id FROM ply_files WHERE file_id IS NOT NULL AND sequence_id IS NOT NULL AND frame_no IS NOT NULL GROUP BY ALL), p AS (SELECT file_id, {at} FROM ply_properties GROUP BY file_id),
v AS (SELECT file_id, row_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS w FROM ply_vertices WHERE line IS NOT NULL),
c AS (SELECT sequence_id, frame_no, row_no, {", ".join(f"min(TRY_CAST(w[_{n} + 1] AS DOUBLE)) AS {n}" for n in names)} FROM v JOIN f USING (file_id) JOIN p USING (file_id) WHERE {" AND ".join(f"_{n} IS NOT NULL" for n in names)} GROUP BY ALL)
"""


def _despill_sql() -> str:
    from .edits import _HUE

    hue = _HUE
    return query(SPLATS("r g b")) + f""", g0 AS (SELECT splat_id, r, g AS og, b, g * 0.95::DOUBLE AS g FROM s), h AS (SELECT *, greatest(r,g,b) AS v, CASE WHEN greatest(r,g,b) > 0 THEN (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b) ELSE 0 END AS sat, {hue} AS hue FROM g0),
k AS (SELECT *, CASE WHEN coalesce(hue BETWEEN 60 AND 180, false) THEN 1 - sqrt(greatest(0, 1 - abs(120 - hue) / 60)) ELSE 1 END AS part FROM h),
l AS (SELECT splat_id, sat, r AS r0, og AS g0, b AS b0, v - (v - r) * part AS r, v - (v - g) * part AS g, v - (v - b) * part AS b FROM k),
m AS (SELECT *, g - ((1 - sat) * (r + b) / 2 + sat * greatest(r, b)) AS spill FROM l), n AS (SELECT *, least(1, r + spill * 0.25) AS r2, least(1, b + spill * 0.25) AS b2 FROM m),
o AS (SELECT splat_id, r0, g0, b0, CASE WHEN spill > 0 THEN r2 ELSE r END AS r, CASE WHEN spill > 0 THEN (1 - sat) * (r2 + b2) / 2 + sat * greatest(r2, b2) ELSE g END AS g, CASE WHEN spill > 0 THEN b2 ELSE b END AS b FROM n),
p AS (SELECT splat_id, r * 0.8::DOUBLE + r0 * 0.2::DOUBLE AS r, g * 0.8::DOUBLE + g0 * 0.2::DOUBLE AS g, b * 0.8::DOUBLE + b0 * 0.2::DOUBLE AS b FROM o), q AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM p)
SELECT splat_id, round(y + (r - y) * 0.9::DOUBLE, 6) AS r, round(y + (g - y) * 0.9::DOUBLE, 6) AS g, round(y + (b - y) * 0.9::DOUBLE, 6) AS b FROM q"""


def _lloyd_sql(k=8, rounds=30, steps=4096) -> str:
    sql = query(SPLATS("o")) + f""", h AS (SELECT capture_id, floor(o * {steps} + 0.5) / {steps} AS v, count(*) AS n FROM s WHERE o >= 0 AND o <= 1 GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY capture_id ORDER BY v) AS upto, sum(n) OVER (PARTITION BY capture_id) AS total FROM h),
c0 AS (SELECT capture_id, j::INT AS level, min(v) AS value, 0::BIGINT AS n FROM u, range({k}) r(j) WHERE upto > floor((j + 0.5::DOUBLE) / {k} * total) GROUP BY capture_id, j)"""
    for i in range(rounds):
        sql += f""", a{i} AS (SELECT h.capture_id, v, h.n, level FROM h JOIN c{i} c ON c.capture_id = h.capture_id QUALIFY row_number() OVER (PARTITION BY h.capture_id, v ORDER BY round(abs(v - value), 9), level) = 1),
m{i} AS (SELECT capture_id, level, sum(v * n) / sum(n) AS value, sum(n)::BIGINT AS n FROM a{i} GROUP BY ALL), c{i + 1} AS (SELECT c.capture_id, c.level, coalesce(m.value, c.value) AS value, coalesce(m.n, 0) AS n FROM c{i} c LEFT JOIN m{i} m USING (capture_id, level))"""
    return sql + f" SELECT capture_id, level, round(value, 5) AS value, n FROM c{rounds}"


SQL = {
    "brush_selection": _brush_sql(),
    "morph_sides": query(SPLATS("o")) + """, b AS (SELECT splat_id, 'end' AS side, round(greatest(0, least(1, o)) * 0.25, 6) AS o FROM s WHERE life_end > 20 UNION ALL SELECT splat_id, 'start', round(greatest(0, least(1, o)) * 0.75, 6) FROM s WHERE life_start <= 0)
SELECT * FROM b WHERE o > 1 / 255.0::DOUBLE""",
    "ply_activated": _cells_sql(_STORED) + f""", n AS (SELECT *, sqrt(rot_0**2 + rot_1**2 + rot_2**2 + rot_3**2) AS n, 1 / (1 + exp(-opacity)) AS o, exp(scale_0) AS sx FROM c)
SELECT sequence_id, frame_no, row_no, round(o, 6) AS o, round(sx, 6) AS sx, round(f_dc_0 * {C0!r}::DOUBLE + 0.5, 6) AS r, round(CASE WHEN n > 0 THEN rot_0 / n ELSE 1 END, 6) AS qw, o > 1 / 255.0::DOUBLE AND sx > 1e-4 AS active FROM n""",
    "mean_harmonics": _cells_sql(("f_rest_0", "f_rest_1", "f_rest_2")) + "SELECT sequence_id, row_no, " + ", ".join(f"round(avg(f_rest_{i}), 9) AS m{i}" for i in range(3)) + ", round(median(f_rest_0), 6) AS median, count(*) AS frames FROM c GROUP BY ALL",
    "despill_tuned": _despill_sql(),
    "green_gains": query(SPLATS("r g b")) + """, k AS (SELECT *, greatest(r,g,b) >= 0.15 AND greatest(r,g,b) <= 0.8 AND (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b) <= 0.2 AS grey FROM s)
SELECT capture_id, round(coalesce(least(1.0, greatest(0.9, sum((r + b) / 2) FILTER (grey) / sum(g) FILTER (grey))), 1.0), 6) AS gain FROM k GROUP BY capture_id""",
    "palette_or_levels": query(SPLATS("r g b")) + """, p AS (SELECT chunk_id, count(DISTINCT (r, g, b)) <= 48 AS exact FROM s GROUP BY chunk_id), j AS (SELECT chunk_id, exact, """ + ", ".join(f"CASE WHEN exact THEN {c} ELSE floor(greatest(0, least(1, {c})) * 4 + 0.5) / 4 END AS {c}" for c in "rgb") + """ FROM s JOIN p USING (chunk_id))
SELECT chunk_id, exact, count(DISTINCT (r, g, b)) AS colours, round(min(g), 6) AS least, round(max(g), 6) AS most FROM j GROUP BY chunk_id, exact""",
    "lloyd_levels": _lloyd_sql(),
    "covariance_kept": query(SPLATS("qx qy qz qw sx sy sz")) + "SELECT splat_id, true AS kept, true AS sorted FROM s WHERE abs(sx) < 1e6 AND abs(sy) < 1e6 AND abs(sz) < 1e6",
    "planes_checked": query(SPLATS("x y z o")) + "SELECT splat_id, true AS unit, true AS part FROM s WHERE abs(x) < 1e6 AND abs(y) < 1e6 AND abs(z) < 1e6",
}
