"""Queries on motion along time: dictionaries at an instant, interpolated rotations, slices, bounds of what lives, resampled paths, atoms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import quat_multiply, quat_normalise, slerp
from ..operators import evaluate as E
from ..util import read
from .base import CAPTURES, CHUNKS, SPLATS, TRAJECTORIES, captures, chunks, query, splats, trajectories

_Q = ("qx", "qy", "qz", "qw")


def _round(c, n):
    """Rounded, but for numbers so large that their last digit is above that place."""
    return F.when(F.abs(c) < 1e9, F.round(c, n)).otherwise(c) + 0.0


def _dictionary(spark, d):
    """Every path of a chunk is an entry of its dictionary: the shift from its first sample, at each sample."""
    p = F.col("p")
    at = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sample")
    t = trajectories(spark, d).where("chunk_id is not null and record_id is not null").select("chunk_id", F.col("record_id").alias("entry"), "p", at)
    return t.select("chunk_id", "entry", "sample", F.array(*[F.get("p", F.col("sample") * 3 + k).cast("double") - p[k].cast("double") for k in range(3)]).alias("xyz"))


def dictionary_positions(spark, d):
    """Positions at 0.37 between the samples 2 and 3: each record's own, and three quarters and a quarter of two dictionary entries."""
    e = F.col("record_id") - F.pmod("record_id", F.lit(5))
    term = lambda i, w: F.struct(i.alias("idx"), F.lit(w).alias("weight"))
    s = splats(spark, d, "x y z").where("chunk_id is not null and record_id is not null")
    s = s.select("splat_id", "chunk_id", "record_id", F.array("x", "y", "z").alias("base"), F.array(term(e, 0.75), term(e + 5, 0.25)).alias("terms"))
    r = E.residual_positions(s, _dictionary(spark, d), 0.37, 2)
    return r.select("splat_id", *[_round(F.col(a), 2).alias(a) for a in "xyz"])


def _beside(spark, d):
    """Each record's quaternion with that of the next record of its chunk."""
    s = splats(spark, d, " ".join(_Q)).where("chunk_id is not null and record_id is not null")
    w = Window.partitionBy("chunk_id").orderBy("record_id", "splat_id")
    n = quat_normalise([F.col(c) for c in _Q])
    s = s.select("splat_id", "chunk_id", "record_id", *[c.alias(a) for a, c in zip(_Q, n)])
    return s, w


def slerped_rotations(spark, d):
    """Three tenths of the way from each record's rotation to the next one's."""
    s, w = _beside(spark, d)
    s = s.select("splat_id", *_Q, *[F.lead(c).over(w).alias(f"n{c}") for c in _Q]).where("nqx is not null")
    out = slerp([F.col(c) for c in _Q], [F.col(f"n{c}") for c in _Q], 0.3)
    return s.select("splat_id", *[(F.round(c, 5) + 0.0).alias(a) for a, c in zip(_Q, out)])


def residual_rotations(spark, d):
    """Each record's rotation turned by the unit sum of what the records before and behind add to none; where the sum has no length,
    it stays."""
    s, w = _beside(spark, d)
    one = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    total = [i + F.coalesce(F.lag(c).over(w), F.lit(0.0)) * 0.5 + F.coalesce(F.lead(c).over(w), F.lit(0.0)) * 0.25 for i, c in zip(one, _Q)]
    s = s.select("splat_id", *_Q, *[t.alias(f"t{c}") for t, c in zip(total, _Q)])
    n = sum((F.col(f"t{c}") * F.col(f"t{c}") for c in _Q), F.lit(0.0))
    turned = quat_multiply([F.col(c) for c in _Q], [F.col(f"t{c}") / F.sqrt(n) for c in _Q])
    return s.select("splat_id", *[(F.round(F.when(n < 1e-12, F.col(c)).otherwise(t), 5) + 0.0).alias(c) for c, t in zip(_Q, turned)])


def sign_continuity(spark, d):
    """Rotations along a chunk's records with signs that never jump: the running product of the signs between neighbours."""
    s, w = _beside(spark, d)
    dot = sum((F.col(c) * F.lag(c).over(w) for c in _Q), F.lit(0.0))
    s = s.withColumn("turn", F.when(dot < 0, 1).otherwise(0))
    sign = F.lit(1) - F.pmod(F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(2)) * 2
    return s.select("splat_id", sign.alias("sign"), (F.round(F.col("qw") * sign, 6) + 0.0).alias("qw"))


def sliced_paths(spark, d):
    """The samples 2 to 5 of every path: where the slice starts, as the running sum of the steps before it, and its steps."""
    p = F.col("p")
    at = lambda i, k: p[3 * i + k].cast("double")
    start = [at(0, k) + (at(1, k) - at(0, k)) + (at(2, k) - at(1, k)) for k in range(3)]
    steps = F.array(*[at(i + 1, k) - at(i, k) for i in range(2, 5) for k in range(3)])
    return trajectories(spark, d).select("vec_id", *[_round(c, 4).alias(n) for c, n in zip(start, "xyz")], F.size(steps).alias("steps"), _round(F.aggregate(steps, F.lit(0.0), lambda a, v: a + v), 4).alias("moved"))


def sliced_lives(spark, d):
    """Lives of the records within the intervals 4 to 15, counted from the slice's start; what doesn't live there is gone."""
    s = splats(spark, d).where("life_start is not null and life_end is not null")
    a, b = F.greatest(F.col("life_start") - 4, F.lit(0)), F.least(F.col("life_end") - 4, F.lit(12))
    return s.select("splat_id", a.alias("life_start"), b.alias("life_end")).where("life_start < life_end")


def live_bounds(spark, d):
    """Bounds of a chunk's paths over the samples at which their records live, widened by an eighth of the longest step."""
    p = trajectories(spark, d).where("chunk_id is not null and record_id is not null").select("chunk_id", "record_id", "p")
    life = splats(spark, d).where("chunk_id is not null and record_id is not null").groupBy("chunk_id", "record_id").agg(F.min("life_start").alias("a"), F.max("life_end").alias("b"))
    j = p.join(life, ["chunk_id", "record_id"]).select("chunk_id", "p", F.explode(F.expr("filter(sequence(0, 7), i -> i >= a AND i + 1 <= b)")).alias("i"))
    at = lambda k, more=0: F.get("p", F.least((F.col("i") + more) * 3 + k, F.lit(21 + k))).cast("double")
    step = F.sqrt(sum(((at(k, 1) - at(k)) ** 2 for k in range(3)), F.lit(0.0)))
    g = j.groupBy("chunk_id").agg(*[f(at(k)).alias(f"{n}{a}") for k, a in enumerate("xyz") for f, n in ((F.min, "lo_"), (F.max, "hi_"))], F.max(step).alias("step"))
    return g.select("chunk_id", *[_round(F.col(f"lo_{a}") - F.col("step") / 8, 4).alias(f"lo_{a}") for a in "xyz"], *[_round(F.col(f"hi_{a}") + F.col("step") / 8, 4).alias(f"hi_{a}") for a in "xyz"])


_BOX = ((-50.0, 120.0), (-1.0, 1.5), (0.0, 2.5))


def chunks_in_box(spark, d):
    """Chunks whose bounds meet a box, decided on the directory alone, and how many of their records lie in it."""
    b = F.col("bounds")
    c = read(spark, d, "chunks").where("chunk_id is not null and size(bounds) = 6").groupBy("chunk_id").agg(F.min("bounds").alias("bounds"))
    for k, (lo, hi) in enumerate(_BOX):
        c = c.where((b[k].cast("double") <= hi) & (b[3 + k].cast("double") >= lo))
    s = splats(spark, d, "x y z")
    for a, (lo, hi) in zip("xyz", _BOX):
        s = s.where((F.col(a) >= lo) & (F.col(a) <= hi))
    return c.select("chunk_id").join(s.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")), "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("inside"))


def extent_radius(spark, d):
    """Centre of each capture's extent, the largest distance from it along the floor, and how far away a camera of 45 degrees sees it whole."""
    s = splats(spark, d, "x y z").where("abs(x) < 1e6 and abs(y) < 1e6 and abs(z) < 1e6")
    box = s.groupBy("capture_id").agg(*[((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"], F.sqrt(sum(((F.max(a) - F.min(a)) ** 2 for a in "xyz"), F.lit(0.0))).alias("diagonal"))
    far = F.max(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2))
    g = s.join(F.broadcast(box) if box.count() <= 100_000 else box, "capture_id").groupBy("capture_id", "cx", "cy", "cz", "diagonal").agg(far.alias("radius"))
    return g.select("capture_id", *[F.round(f"c{a}", 4).alias(f"c{a}") for a in "xyz"], F.round("radius", 4).alias("radius"), F.round(F.col("diagonal") / 2 / math.tan(math.radians(22.5)), 3).alias("distance"))


def resampled_paths(spark, d):
    """Every path at twelve evenly spread times of its own, whatever the rate it was sampled at."""
    t = trajectories(spark, d).select("vec_id", "p", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    out = E.sample_at(F.col("p"), 8, F.col("k") / 11.0)
    return t.select("vec_id", "k", *[_round(c, 4).alias(n) for c, n in zip(out, "xyz")])


def legacy_time(spark, d):
    """Sample and part at a time that loops in single precision, a part above 0.999 going to the next sample."""
    c = chunks(spark, d).join(captures(spark, d).select("capture_id", "time_numerator", "time_denominator"), "capture_id").where("intervals > 0")
    length = (F.col("intervals") * F.col("time_numerator") / F.col("time_denominator"))
    t = F.explode(F.array(*[F.lit(v) for v in (-0.35, 0.2, 0.999999, 1.7, 5.2371)]))
    c = c.select("chunk_id", "intervals", length.alias("length"), t.alias("t"))
    looped = F.pmod(F.col("t").cast("float").cast("double"), F.col("length"))
    at = ((looped / F.col("length")).cast("float") * F.col("intervals").cast("float")).cast("float")
    c = c.select("chunk_id", "intervals", "t", at.alias("at"))
    whole = F.floor("at")
    sample = F.least(whole + F.when(F.col("at") - whole > F.lit(0.999).cast("float"), 1).otherwise(0), F.col("intervals") - 1)
    return c.select("chunk_id", "t", sample.alias("sample"), F.round(F.greatest(F.lit(0.0), F.col("at").cast("double") - sample), 5).alias("alpha"))


def path_pursuit(spark, d):
    """Two rounds of matching pursuit: of four atoms (a push along each axis, and a swing) the one that explains most of a path's
    motion, then the one that explains most of what that leaves."""
    p = F.col("p")
    atoms = E.unit_atoms(8)
    m = [p[3 + i].cast("double") - p[i % 3].cast("double") for i in range(21)]
    t = trajectories(spark, d).select("vec_id", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    for step in (1, 2):
        dots = [sum((F.col(f"m{i}") * float(v) for i, v in enumerate(a) if v), F.lit(0.0)) for a in atoms]
        t = t.withColumns({f"d{j}": x for j, x in enumerate(dots)})
        best = F.array_max(F.array(*[F.struct(F.abs(F.round(f"d{j}", 6)).alias("size"), F.lit(-j).alias("j"), F.col(f"d{j}").alias("w")) for j in range(4)]))
        t = t.withColumn("best", best).withColumns({f"atom{step}": -F.col("best.j"), f"w{step}": F.col("best.w")})
        pick = lambda i: sum((F.when(F.col(f"atom{step}") == j, float(a[i])).otherwise(0.0) for j, a in enumerate(atoms)), F.lit(0.0))  # noqa: E731, B023
        t = t.withColumns({f"m{i}": F.col(f"m{i}") - F.col(f"w{step}") * pick(i) for i in range(21)})
    left = sum((F.col(f"m{i}") ** 2 for i in range(21)), F.lit(0.0))
    return t.select("vec_id", "atom1", _round(F.col("w1"), 3).alias("w1"), "atom2", _round(F.col("w2"), 3).alias("w2"), _round(F.sqrt(left / 7), 3).alias("left"))


_F = (dictionary_positions, slerped_rotations, residual_rotations, sign_continuity, sliced_paths, sliced_lives, live_bounds, chunks_in_box, extent_radius, resampled_paths, legacy_time, path_pursuit)
QUERIES = {f.__name__: f for f in _F}


def _r(e: str, n: int) -> str:
    return f"CASE WHEN abs({e}) < 1e9 THEN round({e}, {n}) ELSE {e} END + 0.0"


_UNIT = "q AS (SELECT splat_id, chunk_id, record_id, " + ", ".join(f"CASE WHEN n > 0 THEN {c} / n ELSE {'1' if c == 'qw' else '0'} END::DOUBLE AS {c}" for c in _Q) + " FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM s WHERE chunk_id IS NOT NULL AND record_id IS NOT NULL))"
_ORDER = "WINDOW w AS (PARTITION BY chunk_id ORDER BY record_id, splat_id)"
_A = 0.37


def _pursuit_sql() -> str:
    atoms = E.unit_atoms(8)
    sql = query(TRAJECTORIES) + ", m0 AS (SELECT vec_id, [" + ", ".join(f"p[{4 + i}]::DOUBLE - p[{i % 3 + 1}]::DOUBLE" for i in range(21)) + "] AS m FROM tr)"
    for step in (1, 2):
        dots = ", ".join("(" + " + ".join(f"m[{i + 1}] * {float(v)!r}::DOUBLE" for i, v in enumerate(a) if v) + f") AS d{j}" for j, a in enumerate(atoms))
        best = "CASE " + " ".join("WHEN " + " AND ".join(f"abs(round(d{j}, 6)) >= abs(round(d{k}, 6))" for k in range(4) if k != j) + f" THEN {j}" for j in range(4)) + " END"
        atom = "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in a) + "]" for a in atoms) + "]"
        sql += f", d{step} AS (SELECT *, {dots} FROM m{step - 1}), b{step} AS (SELECT *, {best} AS atom{step} FROM d{step}), c{step} AS (SELECT * EXCLUDE (d0, d1, d2, d3), [d0, d1, d2, d3][atom{step} + 1] AS w{step} FROM b{step}), m{step} AS (SELECT * REPLACE ([m[i] - w{step} * {atom}[atom{step} + 1][i] for i in range(1, 22)] AS m) FROM c{step})"
    return sql + f" SELECT vec_id, atom1, {_r('w1', 3)} AS w1, atom2, {_r('w2', 3)} AS w2, {_r('sqrt(list_sum([v * v for v in m]) / 7)', 3)} AS \"left\" FROM m2"


SQL = {
    "dictionary_positions": query(SPLATS("x y z"), TRAJECTORIES) + f""", e AS (SELECT chunk_id, record_id AS e, {", ".join(f"(1 - {_A}::DOUBLE) * (p[{7 + k}]::DOUBLE - p[{1 + k}]::DOUBLE) + {_A}::DOUBLE * (p[{10 + k}]::DOUBLE - p[{1 + k}]::DOUBLE) AS d{k}" for k in range(3))} FROM tr WHERE chunk_id IS NOT NULL AND record_id IS NOT NULL),
b AS (SELECT splat_id, chunk_id, x, y, z, record_id - ((record_id % 5) + 5) % 5 AS i FROM s WHERE chunk_id IS NOT NULL AND record_id IS NOT NULL),
j AS (SELECT b.*, """ + ", ".join(f"coalesce(0.75::DOUBLE * a.d{k}, 0) + coalesce(0.25::DOUBLE * c.d{k}, 0) AS m{k}" for k in range(3)) + " FROM b LEFT JOIN e a ON a.chunk_id = b.chunk_id AND a.e = i LEFT JOIN e c ON c.chunk_id = b.chunk_id AND c.e = i + 5) SELECT splat_id, " + ", ".join(f"{_r(f'({a} + m{k})', 2)} AS {a}" for k, a in enumerate("xyz")) + " FROM j",
    "slerped_rotations": query(SPLATS(" ".join(_Q)), _UNIT) + f""", n AS (SELECT splat_id, {", ".join(_Q)}, {", ".join(f"lead({c}) OVER w AS n{c}" for c in _Q)} FROM q {_ORDER}), d AS (SELECT *, {" + ".join(f"{c} * n{c}" for c in _Q)} AS dot FROM n WHERE nqx IS NOT NULL),
a AS (SELECT *, least(1.0, abs(dot)) AS c, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM d),
f AS (SELECT *, CASE WHEN c > 0.9999995::DOUBLE THEN 0.7::DOUBLE ELSE sin(0.7::DOUBLE * acos(c)) / sin(acos(c)) END AS u, CASE WHEN c > 0.9999995::DOUBLE THEN 0.3::DOUBLE ELSE sin(0.3::DOUBLE * acos(c)) / sin(acos(c)) END * sg AS v FROM a),
m AS (SELECT splat_id, {", ".join(f"u * {c} + v * n{c} AS {c}" for c in _Q)} FROM f), l AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM m)
SELECT splat_id, {", ".join(f"round({c} / n, 5) + 0.0 AS {c}" for c in _Q)} FROM l""",
    "residual_rotations": query(SPLATS(" ".join(_Q)), _UNIT) + f""", t AS (SELECT splat_id, {", ".join(_Q)}, {", ".join(f"{1 if c == 'qw' else 0} + coalesce(lag({c}) OVER w, 0) * 0.5 + coalesce(lead({c}) OVER w, 0) * 0.25 AS t{c}" for c in _Q)} FROM q {_ORDER}),
n AS (SELECT *, tqx*tqx + tqy*tqy + tqz*tqz + tqw*tqw AS n FROM t), u AS (SELECT splat_id, {", ".join(_Q)}, n, tqx / sqrt(n) AS a, tqy / sqrt(n) AS b, tqz / sqrt(n) AS c, tqw / sqrt(n) AS d FROM n),
p AS (SELECT splat_id, n, qx AS ox, qy AS oy, qz AS oz, qw AS ow, qw*a + qx*d + qy*c - qz*b AS qx, qw*b - qx*c + qy*d + qz*a AS qy, qw*c + qx*b - qy*a + qz*d AS qz, qw*d - qx*a - qy*b - qz*c AS qw FROM u), l AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS k FROM p)
SELECT splat_id, {", ".join(f"round(CASE WHEN n < 1e-12 THEN o{c[1]} ELSE {c} / k END, 5) + 0.0 AS {c}" for c in _Q)} FROM l""",
    "sign_continuity": query(SPLATS(" ".join(_Q)), _UNIT) + f""", t AS (SELECT *, CASE WHEN {" + ".join(f"{c} * lag({c}) OVER w" for c in _Q)} < 0 THEN 1 ELSE 0 END AS t FROM q {_ORDER}), g AS (SELECT *, 1 - (sum(t) OVER (PARTITION BY chunk_id ORDER BY record_id, splat_id ROWS UNBOUNDED PRECEDING))::BIGINT % 2 * 2 AS g FROM t)
SELECT splat_id, g AS sign, round(qw * g, 6) + 0.0 AS qw FROM g""",
    "sliced_paths": query(TRAJECTORIES) + "SELECT vec_id, " + ", ".join(_r(f"(p[{1 + k}]::DOUBLE + (p[{4 + k}]::DOUBLE - p[{1 + k}]::DOUBLE) + (p[{7 + k}]::DOUBLE - p[{4 + k}]::DOUBLE))", 4) + f" AS {n}" for k, n in enumerate("xyz")) + ", 9 AS steps, " + _r("(" + " + ".join(f"(p[{3 * i + 4 + k}]::DOUBLE - p[{3 * i + 1 + k}]::DOUBLE)" for i in range(2, 5) for k in range(3)) + ")", 4) + " AS moved FROM tr",
    "sliced_lives": query(SPLATS()) + ", l AS (SELECT splat_id, greatest(life_start - 4, 0)::INT AS life_start, least(life_end - 4, 12)::INT AS life_end FROM s WHERE life_start IS NOT NULL AND life_end IS NOT NULL) SELECT * FROM l WHERE life_start < life_end",
    "live_bounds": query(SPLATS(), TRAJECTORIES) + """, l AS (SELECT chunk_id, record_id, min(life_start) AS a, max(life_end) AS b FROM s WHERE chunk_id IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL), j AS (SELECT chunk_id, p, i FROM tr JOIN l USING (chunk_id, record_id), range(8) r(i) WHERE i >= a AND i + 1 <= b),
v AS (SELECT chunk_id, """ + ", ".join(f"p[i * 3 + {1 + k}]::DOUBLE AS {a}, p[least((i + 1) * 3 + {1 + k}, {22 + k})]::DOUBLE AS n{a}" for k, a in enumerate("xyz")) + """ FROM j),
g AS (SELECT chunk_id, """ + ", ".join(f"min({a}) AS l{a}, max({a}) AS h{a}" for a in "xyz") + ", max(sqrt((nx-x)**2 + (ny-y)**2 + (nz-z)**2)) AS step FROM v GROUP BY chunk_id) SELECT chunk_id, " + ", ".join(_r(f"(l{a} - step / 8)", 4) + f" AS lo_{a}, " + _r(f"(h{a} + step / 8)", 4) + f" AS hi_{a}" for a in "xyz") + " FROM g",
    "chunks_in_box": query(SPLATS("x y z")) + ", c AS (SELECT chunk_id, min(bounds) AS b FROM chunks WHERE chunk_id IS NOT NULL AND len(bounds) = 6 GROUP BY chunk_id), k AS (SELECT chunk_id FROM c WHERE " + " AND ".join(f"b[{k + 1}]::DOUBLE <= {hi} AND b[{k + 4}]::DOUBLE >= {lo}" for k, (lo, hi) in enumerate(_BOX)) + "), n AS (SELECT chunk_id, count(*) AS n FROM s WHERE " + " AND ".join(f"{a} >= {lo} AND {a} <= {hi}" for a, (lo, hi) in zip("xyz", _BOX)) + " GROUP BY chunk_id) SELECT chunk_id, coalesce(n, 0) AS inside FROM k LEFT JOIN n USING (chunk_id)",
    "extent_radius": query(SPLATS("x y z")) + f""", t AS (SELECT * FROM s WHERE abs(x) < 1e6 AND abs(y) < 1e6 AND abs(z) < 1e6), b AS (SELECT capture_id, {", ".join(f"(min({a}) + max({a})) / 2 AS c{a}" for a in "xyz")}, sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2) AS dg FROM t GROUP BY capture_id)
SELECT capture_id, round(any_value(cx), 4) AS cx, round(any_value(cy), 4) AS cy, round(any_value(cz), 4) AS cz, round(max(sqrt((x-cx)**2 + (z-cz)**2)), 4) AS radius, round(any_value(dg) / 2 / {math.tan(math.radians(22.5))!r}::DOUBLE, 3) AS distance FROM t JOIN b USING (capture_id) GROUP BY capture_id""",
    "resampled_paths": query(TRAJECTORIES) + ", t AS (SELECT vec_id, p, k::INT AS k, k / 11.0::DOUBLE * 7 AS u, least(floor(k / 11.0::DOUBLE * 7), 6)::INT AS i FROM tr, range(12) r(k)) SELECT vec_id, k, " + ", ".join(_r(f"((1 - (u - i)) * p[i * 3 + {1 + k}]::DOUBLE + (u - i) * p[i * 3 + {4 + k}]::DOUBLE)", 4) + f" AS {n}" for k, n in enumerate("xyz")) + " FROM t",
    "legacy_time": query(CAPTURES, CHUNKS) + """, c AS (SELECT chunk_id, intervals, intervals * time_numerator / time_denominator AS len, unnest([-0.35, 0.2, 0.999999, 1.7, 5.2371]::DOUBLE[]) AS t FROM ch JOIN cap USING (capture_id) WHERE intervals > 0),
l AS (SELECT *, t::FLOAT::DOUBLE - floor(t::FLOAT::DOUBLE / len) * len AS looped FROM c), a AS (SELECT *, ((looped / len)::FLOAT * intervals::FLOAT)::FLOAT AS u FROM l), w AS (SELECT *, least(floor(u) + CASE WHEN u - floor(u) > 0.999::FLOAT THEN 1 ELSE 0 END, intervals - 1)::BIGINT AS sample FROM a)
SELECT chunk_id, t, sample, round(greatest(0.0, u::DOUBLE - sample), 5) AS alpha FROM w""",
    "path_pursuit": _pursuit_sql(),
}
