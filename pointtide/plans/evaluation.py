"""Queries on evaluation, picking, segmentation and fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.geometry import Transform
from ..operators import evaluate as E
from .base import INTERVALS, SPLATS, TRAJECTORIES, chunks, intervals, query, splats, trajectories

_LASSO = [(-150.0, -1.0), (150.0, -1.5), (260.0, 0.5), (0.0, 1.5), (-150.0, 1.0)]


def trajectory_at(spark, d):
    out = E.sample_at(F.col("p"), 8, F.lit(0.37))
    return trajectories(spark, d).select("vec_id", *[F.round(c, 5).alias(n) for c, n in zip(out, "xyz")])


def lasso_pick(spark, d):
    return splats(spark, d, "x y").where(E.polygon_contains(F.col("x"), F.col("y"), _LASSO)).select("splat_id")


def capped_segments(spark, d):
    return E.capped_segments(intervals(spark, d), ["chunk_id"], "interval_no", "generation", 16)


def motion_atoms(spark, d):
    m = E.motion_atoms(trajectories(spark, d), "capture_id", "vec_id", "p", 8)
    return m.select("vec_id", F.round("weight", 4).alias("weight"), F.round("error", 4).alias("error"))


def covariance_bake(spark, d):
    m = Transform(rotation=(10, 20, 30), scale=(1.0, 2.0, 0.5)).matrix()[:3, :3]
    return E.covariance_bake(splats(spark, d, "qx qy qz qw sx sy sz").select("splat_id", "qx", "qy", "qz", "qw", "sx", "sy", "sz"), m)


def median_cut_palette(spark, d):
    """Up to 16 colours per chunk. A chunk's colours fit one task: the format bounds its records."""
    s = splats(spark, d, "r g b").select("chunk_id", "r", "g", "b")

    def cut(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(c).to_numpy() for c in "rgb"], 1)
        # equal sets of colours give equal palettes, in whatever order the rows come
        pal, code = E.median_cut(x[np.lexsort(x.T)], 16)
        return pa.table({"chunk_id": pa.array([t.column("chunk_id")[0].as_py()] * len(pal), pa.int64()), "code": np.arange(len(pal)), "uses": np.bincount(code), "r": pal[:, 0], "g": pal[:, 1], "b": pal[:, 2]})

    return s.groupBy("chunk_id").applyInArrow(cut, "chunk_id bigint, code bigint, uses bigint, r double, g double, b double")


def contribution_scores(spark, d):
    from ..operators.surface import contribution_scores as scores, ring_of_views

    c = scores(splats(spark, d, "x y z o"), ["chunk_id"], "splat_id", ring_of_views(4), 16)
    return c.select("splat_id", F.round("score", 6).alias("score"))


def contribution_rendered(spark, d):
    """The whole score: 24 views at 4 instants, 256 pixels, footprints and lives. A chunk's records fit one task: the format bounds them."""
    from ..operators.surface import rendered_contributions

    length = chunks(spark, d).select("chunk_id", "intervals")
    return rendered_contributions(splats(spark, d, "x y z qx qy qz qw sx sy sz o").join(length, "chunk_id", "left"), ["chunk_id"], "splat_id")


def oriented_normals(spark, d):
    from ..operators.surface import oriented_normals as normals

    return normals(splats(spark, d, "x y z qx qy qz qw sx sy sz o"), ["chunk_id"], "splat_id")


def likest_partner(spark, d):
    """Of every record alive at the start of its chunk the likest that is alive at sample 20."""
    from ..operators.frames import alive_at
    from ..operators.surface import likest_partner as partner

    s = splats(spark, d, "x y z r g b")
    out = partner(s.where(alive_at(F.lit(0))), s.where(alive_at(F.lit(20))), ["chunk_id"], "splat_id")
    return out.select("splat_id", "partner", F.round("distance", 6).alias("distance"))


def recovered_colour(spark, d):
    """Warm records stand for the surfaces that colour is recovered from, after despilling."""
    from ..functions.colour import despill
    from ..operators.surface import recover_colour

    s = splats(spark, d, "x y z r g b o")
    out = despill(F.col("r"), F.col("g"), F.col("b"))
    s = s.withColumns({f"{c}0": F.col(c) for c in "rgb"}).withColumns({f"_{c}": v for c, v in zip("rgb", out)}).withColumns({c: F.col(f"_{c}") for c in "rgb"}).drop("_r", "_g", "_b")
    return recover_colour(s, ["chunk_id"], "splat_id", (F.col("r") > F.col("b")) & (F.col("o") > 0.15), F.col("r") >= F.col("b") - 0.015, link=0.2, least=10, extent=0.12, reach=0.4, eighth=0.4)


_F = (contribution_scores, contribution_rendered, oriented_normals, likest_partner, recovered_colour, trajectory_at, lasso_pick, capped_segments, motion_atoms, covariance_bake, median_cut_palette)
QUERIES = {f.__name__: f for f in _F}


def _edges():
    out = []
    for (x0, y0), (x1, y1) in zip(_LASSO, _LASSO[1:] + _LASSO[:1]):
        if y0 != y1:
            out.append(f"CASE WHEN y >= {min(y0, y1)}::DOUBLE AND y < {max(y0, y1)}::DOUBLE AND x < (y - ({y0})::DOUBLE) * ({(x1 - x0) / (y1 - y0)!r})::DOUBLE + ({x0})::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(out)


def _rays():
    from ..operators.surface import ring_of_views

    dot = lambda v: " + ".join(f"(({float(c)!r})::DOUBLE * {a})" for c, a in zip(v, ("rx", "ry", "rz")))
    return " UNION ALL ".join(f"SELECT chunk_id, splat_id, o, {i} AS v, floor((({dot(r)}) / span + 0.9) * 16)::INT AS px, floor((({dot(u)}) / span + 0.9) * 16)::INT AS py, {dot(f)} AS depth FROM d" for i, (r, u, f) in enumerate(ring_of_views(4)))


_A = 0.37 * 7 - 2
SQL = {
    "contribution_scores": query(SPLATS("x y z o")) + """, b AS (SELECT chunk_id, (max(x) + min(x)) / 2 AS cx, (max(y) + min(y)) / 2 AS cy, (max(z) + min(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1e-9) AS span FROM s GROUP BY chunk_id),
d AS (SELECT chunk_id, splat_id, o, x - cx AS rx, y - cy AS ry, z - cz AS rz, span FROM s JOIN b USING (chunk_id)), rays AS (""" + _rays() + """),
t AS (SELECT splat_id, greatest(0, least(1, o)) AS a, coalesce(max(CASE WHEN o >= 1 THEN 1 ELSE 0 END) OVER w, 0) AS solid, coalesce(sum(CASE WHEN o < 1 THEN ln(1 - greatest(0, o)) END) OVER w, 0) AS l FROM rays
WINDOW w AS (PARTITION BY chunk_id, v, px, py ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT splat_id, round(sum(a * CASE WHEN solid = 1 THEN 0 ELSE exp(l) END) / 4, 6) AS score FROM t GROUP BY splat_id""",
    "likest_partner": query(SPLATS("x y z r g b")) + """, c AS (SELECT a.splat_id, b.splat_id AS partner, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 + 0.0025::DOUBLE * ((greatest(0, least(1, a.r)) - greatest(0, least(1, b.r)))**2 + (greatest(0, least(1, a.g)) - greatest(0, least(1, b.g)))**2 + (greatest(0, least(1, a.b)) - greatest(0, least(1, b.b)))**2)) AS q
FROM s a JOIN s b ON a.chunk_id = b.chunk_id WHERE a.life_start <= 0 AND a.life_end >= 1 AND b.life_start <= 20 AND b.life_end >= 21) SELECT splat_id, partner, round(q, 6) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY splat_id ORDER BY q, partner) = 1""",
    "trajectory_at": query(TRAJECTORIES) + "SELECT vec_id, " + ", ".join(f"round({1 - _A!r}::DOUBLE * p[{7 + k}]::DOUBLE + {_A!r}::DOUBLE * p[{10 + k}]::DOUBLE, 5) AS {n}" for k, n in enumerate("xyz")) + " FROM tr",
    "lasso_pick": query(SPLATS("x y")) + f"SELECT splat_id FROM s WHERE ({_edges()}) % 2 = 1",
    "capped_segments": query(INTERVALS) + """, f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR generation IS DISTINCT FROM lag(generation) OVER w THEN 1 ELSE 0 END AS f FROM iv WINDOW w AS (PARTITION BY chunk_id ORDER BY interval_no)),
g AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id ORDER BY interval_no ROWS UNBOUNDED PRECEDING) AS run FROM f), k AS (SELECT *, (row_number() OVER (PARTITION BY chunk_id, run ORDER BY interval_no) - 1) // 16 AS k FROM g)
SELECT chunk_id, min(interval_no) AS first, max(interval_no) AS last, count(*) AS n FROM k GROUP BY chunk_id, run, k""",
    "motion_atoms": query(TRAJECTORIES) + """, m AS (SELECT capture_id, vec_id, i, p[i + 4]::DOUBLE - p[i % 3 + 1]::DOUBLE AS m FROM tr, range(21) r(i)), a AS (SELECT capture_id, i, avg(m) AS a FROM m GROUP BY ALL),
w AS (SELECT vec_id, sum(m * a) / sum(a * a) AS w FROM m JOIN a USING (capture_id, i) GROUP BY vec_id)
SELECT vec_id, round(any_value(w), 4) AS weight, round(sqrt(sum((m - w * a) ** 2) / 7), 4) AS error FROM m JOIN a USING (capture_id, i) JOIN w USING (vec_id) GROUP BY vec_id""",
}
