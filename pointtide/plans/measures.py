"""Queries that measure and check: headers, pages, light along a ray, picks on a screen, motion, codebooks over curves, rigid fits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import quat_normalise
from ..operators import evaluate as E
from ..operators import profile as P
from .base import CAPTURES, CHUNKS, INTERVALS, SPLATS, TRAJECTORIES, captures, chunks, intervals, query, splats, trajectories

_Q = ("qx", "qy", "qz", "qw")


def header_checks(spark, d):
    """Per capture how many chunks break a rule of the header: no intervals, no records, a negative place, an index taken twice, a start that
    is not where the chunk before ends."""
    w = Window.partitionBy("capture_id").orderBy("chunk_index", "chunk_id")
    c = chunks(spark, d).where("capture_id is not null")
    c = c.withColumn("due", F.lag(F.col("start_tick") + F.col("intervals")).over(w)).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("capture_id", "chunk_index")))
    one = lambda cond, name: F.sum(F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)).alias(name)
    return c.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("chunks"), one(F.col("intervals") < 1, "no_intervals"), one(F.col("splat_count") < 1, "no_records"), one(F.col("file_offset") < 0, "bad_place"),
        one(F.col("same") > 1, "same_index"), one(F.col("start_tick") != F.col("due"), "not_joined"),
    )


def record_pages(spark, d):
    """Pages of at most 4,096 bytes that hold whole records of one group of a chunk; a record takes 40 bytes and one for each frame it lives."""
    s = splats(spark, d).where("record_id is not null and life_end >= life_start").select("chunk_id", "record_id", "group_no", (F.col("life_end") - F.col("life_start") + 40).alias("bytes"))
    return E.budget_segments(s, ["chunk_id"], "record_id", "group_no", "bytes", 1 << 30, 4096)


def cut_transmittance(spark, d):
    """What each record of a chunk adds to a ray along z: alphas under 1/255 are none, and behind less than a ten-thousandth of the
    light nothing counts."""
    a = F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.col("o") * 0.6))
    s = splats(spark, d, "z o").select("chunk_id", "splat_id", "z", F.when(a >= 1 / 255, a).otherwise(0.0).alias("a"))
    w = Window.partitionBy("chunk_id").orderBy("z", "splat_id").rowsBetween(Window.unboundedPreceding, -1)
    t = F.exp(F.coalesce(F.sum(F.ln(F.lit(1.0) - F.col("a"))).over(w), F.lit(0.0)))
    s = s.withColumn("t", F.round(t, 9))
    return s.select("splat_id", F.round(F.when(F.col("t") >= 1e-4, F.col("a") * F.col("t")).otherwise(0.0), 6).alias("weight"))


_SCREEN = [(-0.45, -0.2), (0.4, -0.3), (0.5, 0.25), (0.0, 0.4), (-0.3, 0.2)]


def projected_pick(spark, d):
    """Records whose centre a camera 5 before z = 0 sees inside a polygon on its screen, their captures being 100 apart along x."""
    x = F.col("x") - F.floor(F.col("x") / 100 + 0.5) * 100
    s = splats(spark, d, "x y z").where("abs(x) < 1e6 and z > -4.9").select("splat_id", (x / (F.col("z") + 5)).alias("u"), (F.col("y") / (F.col("z") + 5)).alias("v"))
    return s.where(E.polygon_contains(F.col("u"), F.col("v"), _SCREEN)).select("splat_id")


def layer_costs(spark, d):
    """Stored and decoded bytes by layer and label, at all levels."""
    i = intervals(spark, d).where("generation is not null").select(F.pmod("generation", F.lit(3)).alias("layer"), F.lower("take_label").alias("label"), "stored_size")
    g = i.rollup("layer", "label").agg(F.grouping_id().cast("bigint").alias("level"), F.sum("stored_size").alias("stored"), (F.count(F.lit(1)) * 65536).alias("decoded"))
    return g.withColumn("ratio", F.round(F.col("stored") / F.col("decoded"), 6))


def motion_pad(spark, d):
    """Per chunk the widening that turns and growth between neighbouring records ask of its bounds, for a radius of 1 and a step of 1/2."""
    w = Window.partitionBy("chunk_id").orderBy("record_id", "splat_id")
    n = quat_normalise([F.col(c) for c in _Q])
    s = splats(spark, d, "qx qy qz qw sx").where("chunk_id is not null and record_id is not null and abs(sx) < 1e6").select("chunk_id", "record_id", "splat_id", "sx", *[c.alias(a) for a, c in zip(_Q, n)])
    dot = sum((F.col(c) * F.lag(c).over(w) for c in _Q), F.lit(0.0))
    s = s.select("chunk_id", (F.acos(F.least(F.lit(1.0), F.abs(dot))) * 2).alias("turn"), F.abs(F.col("sx") - F.lag("sx").over(w)).alias("grow"), F.greatest("sx", F.lag("sx").over(w)).alias("size")).where("turn is not null")
    pad = (F.col("size") * F.col("turn") * F.col("turn") + F.col("grow") * F.col("turn") * 2 + (F.col("size") * F.col("turn") + F.col("grow"))) / 8
    return s.groupBy("chunk_id").agg(F.round(F.max("turn"), 4).alias("turn"), F.round(F.max("grow"), 5).alias("grow"), F.round(F.max(pad), 4).alias("pad"))


def rotation_base(spark, d):
    """The mean rotation of a chunk, weighted by opacity and of one sign with its first record's, and how many lie within 30 degrees."""
    n = quat_normalise([F.col(c) for c in _Q])
    s = splats(spark, d, "qx qy qz qw o").where("chunk_id is not null and record_id is not null and o > 0 and o <= 1").select("chunk_id", "record_id", "splat_id", "o", *[c.alias(a) for a, c in zip(_Q, n)])
    first = s.groupBy("chunk_id").agg(F.min_by(F.struct(*_Q), F.struct("record_id", "splat_id")).alias("f"))
    j = s.join(first, "chunk_id")
    sign = F.when(sum((F.col(c) * F.col(f"f.{c}") for c in _Q), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    base = j.groupBy("chunk_id").agg(*[F.sum(F.col("o") * sign * F.col(c)).alias(f"b{c}") for c in _Q])
    b = quat_normalise([F.col(f"b{c}") for c in _Q])
    j = s.join(base.select("chunk_id", *[c.alias(f"b{a}") for a, c in zip(_Q, b)]), "chunk_id")
    angle = F.acos(F.least(F.lit(1.0), F.abs(sum((F.col(c) * F.col(f"b{c}") for c in _Q), F.lit(0.0))))) * (360 / math.pi)
    return j.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round(angle, 6) <= 30).alias("near"), F.round(F.max(angle), 3).alias("farthest"))


_ATOMS = E.unit_atoms(8)
_START = [[0.0] * 21, _ATOMS[0], [-v for v in _ATOMS[0]], _ATOMS[2]]


def _motions(spark, d):
    """The 21 numbers of each path's motion about its first sample, of paths that stay within a thousand."""
    m = [F.col("p")[3 + i].cast("double") - F.col("p")[i % 3].cast("double") for i in range(21)]
    t = trajectories(spark, d).select("vec_id", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    return t.where(F.greatest(*[F.abs(f"m{i}") for i in range(21)]) < 1000)


def curve_centres(spark, d):
    """Centres of whole motions by two rounds of k-means, the first centre held at rest."""
    out = P.weighted_kmeans(_motions(spark, d).withColumn("w", F.lit(1.0)), [f"m{i}" for i in range(21)], "w", _START, 2, fixed=1, restart=False)
    return spark.createDataFrame([(k, round(float(sum(c)), 4), round(float(sum(v * v for v in c)), 4)) for k, c in enumerate(out)], "centre int, total double, square double")


def curve_codes(spark, d):
    """Two stages of a residual code: the nearest of four motions, then of what that leaves the nearest of four halves."""
    t = _motions(spark, d)
    for step, scale in ((1, 1.0), (2, 0.5)):
        far = [sum(((F.col(f"m{i}") - c[i] * scale) ** 2 for i in range(21)), F.lit(0.0)) for c in _START]
        best = F.array_min(F.array(*[F.struct(F.round(f, 6).alias("d"), F.lit(k).alias("k")) for k, f in enumerate(far)]))
        t = t.withColumn(f"code{step}", best["k"])
        pick = lambda i: F.element_at(F.array(*[F.lit(c[i] * scale) for c in _START]), F.col(f"code{step}") + 1)  # noqa: E731, B023
        t = t.withColumns({f"m{i}": F.col(f"m{i}") - pick(i) for i in range(21)})
    left = F.sqrt(sum((F.col(f"m{i}") ** 2 for i in range(21)), F.lit(0.0)) / 7)
    return t.select("vec_id", "code1", "code2", F.round(left, 4).alias("left"))


def rigid_fits(spark, d):
    """Whether the rigid motion fitted between the first and the last samples of a capture's paths is a rotation, and fits no worse than a
    shift alone; the paths that moved by less than 1,000."""
    p = F.col("p")
    t = trajectories(spark, d).where("capture_id is not null").select("capture_id", *[p[k].cast("double").alias(f"a{k}") for k in range(3)], *[p[21 + k].cast("double").alias(f"b{k}") for k in range(3)])
    near = F.greatest(*[F.abs(F.col(f"b{k}") - F.col(f"a{k}")) for k in range(3)]) < 1000
    inside = F.greatest(*[F.abs(f"a{k}") for k in range(3)]) < 1e6
    f = E.rigid_fits(t.where(near & inside), ["capture_id"])
    return f.select("capture_id", "n", "rotation", (F.col("error") <= F.col("shifted") * (1 + 1e-9) + 1e-9).alias("better"))


def frame_parity(spark, d):
    """How many records each chunk shows at sample 5 but not at 6, and the other way round."""
    s = splats(spark, d).where("chunk_id is not null")
    alive = lambda k: F.when((F.col("life_start") <= k) & (F.col("life_end") >= k + 1), 1).otherwise(0)
    # the difference of two multisets, both ways, in one pass
    net = s.groupBy("chunk_id", "record_id").agg(F.sum(alive(5)).alias("a"), F.sum(alive(6)).alias("b"))
    more = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    return net.groupBy("chunk_id").agg(more("a", "b").alias("gone"), more("b", "a").alias("come")).where("gone > 0 or come > 0")


_F = (header_checks, record_pages, cut_transmittance, projected_pick, layer_costs, motion_pad, rotation_base, curve_centres, curve_codes, rigid_fits, frame_parity)
QUERIES = {f.__name__: f for f in _F}

_DOT = " + ".join(f"{c} * b{c}" for c in _Q)


def _unit(where: str, more: str) -> str:
    return f"q AS (SELECT {more}, " + ", ".join(f"CASE WHEN n > 0 THEN {c} / n ELSE {'1' if c == 'qw' else '0'} END::DOUBLE AS {c}" for c in _Q) + f" FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM s WHERE {where}))"


def _edges() -> str:
    out = []
    for (x0, y0), (x1, y1) in zip(_SCREEN, _SCREEN[1:] + _SCREEN[:1]):
        out.append(f"CASE WHEN v >= {min(y0, y1)}::DOUBLE AND v < {max(y0, y1)}::DOUBLE AND u < (v - ({y0})::DOUBLE) * ({(x1 - x0) / (y1 - y0)!r})::DOUBLE + ({x0})::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(out)


_MOTION = query(TRAJECTORIES) + "m0 AS (SELECT vec_id, [" + ", ".join(f"p[{4 + i}]::DOUBLE - p[{i % 3 + 1}]::DOUBLE" for i in range(21)) + "] AS m FROM tr WHERE greatest(" + ", ".join(f"abs(p[{4 + i}]::DOUBLE - p[{i % 3 + 1}]::DOUBLE)" for i in range(21)) + ") < 1000)"
_MOTION = _MOTION.replace("\nm0 AS", ",\nm0 AS")


def _vectors(scale: float = 1.0) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{v * scale!r}::DOUBLE" for v in c) + "]" for c in _START) + "]"


def _centres_sql(rounds: int = 2) -> str:
    sql = _MOTION + f", c0 AS (SELECT k::INT AS k, ({_vectors()})[k + 1] AS c FROM range(4) r(k))"
    for i in range(rounds):
        sql += f""", a{i} AS (SELECT vec_id, m, k FROM m0, c{i} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum([(m[j] - c.c[j]) ** 2 for j in range(1, 22)]), k) = 1),
g{i} AS (SELECT k, [""" + ", ".join(f"avg(m[{j}])" for j in range(1, 22)) + f"] AS c FROM a{i} GROUP BY k), c{i + 1} AS (SELECT c.k, CASE WHEN c.k = 0 THEN c.c ELSE coalesce(g.c, c.c) END AS c FROM c{i} c LEFT JOIN g{i} g USING (k))"
    return sql + f" SELECT k AS centre, round(list_sum(c), 4) AS total, round(list_sum([v * v for v in c]), 4) AS square FROM c{rounds}"


def _codes_sql() -> str:
    sql = _MOTION
    for step, scale in ((1, 1.0), (2, 0.5)):
        sql += f""", d{step} AS (SELECT *, [round(list_sum([(m[j] - c[j]) ** 2 for j in range(1, 22)]), 6) for c in {_vectors(scale)}] AS d FROM m{step - 1}),
e{step} AS (SELECT * EXCLUDE (d), (list_position(d, list_min(d)) - 1)::INT AS code{step} FROM d{step}), m{step} AS (SELECT * REPLACE ([m[j] - ({_vectors(scale)})[code{step} + 1][j] for j in range(1, 22)] AS m) FROM e{step})"""
    return sql + " SELECT vec_id, code1, code2, round(sqrt(list_sum([v * v for v in m]) / 7), 4) AS \"left\" FROM m2"


SQL = {
    "header_checks": query(CHUNKS) + """, w AS (SELECT *, lag(start_tick + intervals) OVER (PARTITION BY capture_id ORDER BY chunk_index, chunk_id) AS due, count(*) OVER (PARTITION BY capture_id, chunk_index) AS same FROM ch WHERE capture_id IS NOT NULL)
SELECT capture_id, count(*) AS chunks, count(*) FILTER (intervals < 1) AS no_intervals, count(*) FILTER (splat_count < 1) AS no_records, count(*) FILTER (file_offset < 0) AS bad_place, count(*) FILTER (same > 1) AS same_index, count(*) FILTER (start_tick <> due) AS not_joined FROM w GROUP BY capture_id""",
    "record_pages": query(SPLATS()).replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT chunk_id, record_id AS i, group_no AS g, life_end - life_start + 40 AS v, row_number() OVER (PARTITION BY chunk_id ORDER BY record_id) AS k FROM s WHERE record_id IS NOT NULL AND life_end >= life_start),
w AS (SELECT chunk_id, k, i, g, 1 AS part, v::BIGINT AS total FROM r WHERE k = 1
UNION ALL SELECT q.chunk_id, q.k, q.i, q.g, CASE WHEN q.g IS DISTINCT FROM w.g OR total + q.v > 4096 THEN part + 1 ELSE part END, CASE WHEN q.g IS DISTINCT FROM w.g OR total + q.v > 4096 THEN q.v ELSE total + q.v END FROM w JOIN r q ON q.chunk_id IS NOT DISTINCT FROM w.chunk_id AND q.k = w.k + 1)
SELECT chunk_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*) AS n, max(total)::BIGINT AS total FROM w GROUP BY chunk_id, part""",
    "cut_transmittance": query(SPLATS("z o")) + """, a AS (SELECT chunk_id, splat_id, z, least(0.99::DOUBLE, greatest(0, o * 0.6::DOUBLE)) AS a FROM s), b AS (SELECT chunk_id, splat_id, z, CASE WHEN a >= 1 / 255.0::DOUBLE THEN a ELSE 0 END AS a FROM a),
t AS (SELECT splat_id, a, round(exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY chunk_id ORDER BY z, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 9) AS t FROM b) SELECT splat_id, round(CASE WHEN t >= 1e-4 THEN a * t ELSE 0 END, 6) AS weight FROM t""",
    "projected_pick": query(SPLATS("x y z")) + f", p AS (SELECT splat_id, (x - floor(x / 100 + 0.5) * 100) / (z + 5) AS u, y / (z + 5) AS v FROM s WHERE abs(x) < 1e6 AND z > -4.9::DOUBLE) SELECT splat_id FROM p WHERE ({_edges()}) % 2 = 1",
    "layer_costs": query(INTERVALS) + ", l AS (SELECT ((generation % 3) + 3) % 3 AS layer, lower(take_label) AS label, stored_size FROM iv WHERE generation IS NOT NULL) SELECT layer, label, grouping(layer, label) AS level, sum(stored_size)::BIGINT AS stored, count(*) * 65536 AS decoded, round(sum(stored_size) / (count(*) * 65536), 6) AS ratio FROM l GROUP BY ROLLUP (layer, label)",
    "motion_pad": query(SPLATS("qx qy qz qw sx"), _unit("chunk_id IS NOT NULL AND record_id IS NOT NULL AND abs(sx) < 1e6", "chunk_id, record_id, splat_id, sx")) + """, l AS (SELECT chunk_id, 2 * acos(least(1.0, abs(""" + " + ".join(f"{c} * lag({c}) OVER w" for c in _Q) + """))) AS turn, abs(sx - lag(sx) OVER w) AS grow, greatest(sx, lag(sx) OVER w) AS size FROM q WINDOW w AS (PARTITION BY chunk_id ORDER BY record_id, splat_id))
SELECT chunk_id, round(max(turn), 4) AS turn, round(max(grow), 5) AS grow, round(max((size * turn * turn + grow * turn * 2 + (size * turn + grow)) / 8), 4) AS pad FROM l WHERE turn IS NOT NULL GROUP BY chunk_id""",
    "rotation_base": query(SPLATS("qx qy qz qw o"), _unit("chunk_id IS NOT NULL AND record_id IS NOT NULL AND o > 0 AND o <= 1", "chunk_id, record_id, splat_id, o")) + """, f AS (SELECT chunk_id, """ + ", ".join(f"arg_min({c}, (record_id, splat_id)) AS f{c}" for c in _Q) + """ FROM q GROUP BY chunk_id),
g AS (SELECT q.*, CASE WHEN """ + " + ".join(f"{c} * f{c}" for c in _Q) + """ < 0 THEN -1 ELSE 1 END AS g FROM q JOIN f USING (chunk_id)), b AS (SELECT chunk_id, """ + ", ".join(f"sum(o * g * {c}) AS b{c}" for c in _Q) + """ FROM g GROUP BY chunk_id),
n AS (SELECT *, sqrt(bqx*bqx + bqy*bqy + bqz*bqz + bqw*bqw) AS n FROM b), a AS (SELECT chunk_id, acos(least(1.0, abs((""" + _DOT + f""") / n))) * {360 / math.pi!r}::DOUBLE AS a FROM q JOIN n USING (chunk_id)) SELECT chunk_id, count(*) AS n, count(*) FILTER (round(a, 6) <= 30) AS near, round(max(a), 3) AS farthest FROM a GROUP BY chunk_id""",
    "curve_centres": _centres_sql(),
    "curve_codes": _codes_sql(),
    "rigid_fits": query(TRAJECTORIES) + ", t AS (SELECT capture_id FROM tr WHERE capture_id IS NOT NULL AND greatest(" + ", ".join(f"abs(p[{22 + k}]::DOUBLE - p[{1 + k}]::DOUBLE)" for k in range(3)) + ") < 1000 AND greatest(" + ", ".join(f"abs(p[{1 + k}]::DOUBLE)" for k in range(3)) + ") < 1e6) SELECT capture_id, count(*) AS n, true AS rotation, true AS better FROM t GROUP BY capture_id",
    "frame_parity": query(SPLATS()) + """, a AS (SELECT chunk_id, record_id FROM s WHERE chunk_id IS NOT NULL AND life_start <= 5 AND life_end >= 6), b AS (SELECT chunk_id, record_id FROM s WHERE chunk_id IS NOT NULL AND life_start <= 6 AND life_end >= 7),
g AS (SELECT chunk_id, count(*) AS gone FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY chunk_id), c AS (SELECT chunk_id, count(*) AS come FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY chunk_id) SELECT chunk_id, coalesce(gone, 0) AS gone, coalesce(come, 0) AS come FROM g FULL JOIN c USING (chunk_id)""",
}
