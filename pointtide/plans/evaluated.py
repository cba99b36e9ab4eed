"""Queries that evaluate coded records whole: all attributes at an instant, harmonics summed and turned, depth buffers, levels, caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.colour import C0
from ..functions.geometry import Transform
from ..operators import evaluate as E
from ..util import read
from .base import CAPTURES, CHUNKS, INTERVALS, SPLATS, TRAJECTORIES, captures, chunks, intervals, query, splats, trajectories

_Q = ("qx", "qy", "qz", "qw")
#: A motion that chunks of odd number make: shift, unit quaternion, size.
_SHIFT, _TURN, _SIZE = (0.5, -1.0, 2.0), (0.0, 0.6, 0.0, 0.8), 1.5


def evaluated_frame(spark, d):
    """All attributes at 0.25 between the samples 5 and 6: rotations between two stored ones, staged opacities and colours, the chunk's
    motion."""
    w = Window.partitionBy("chunk_id").orderBy("record_id", "splat_id")
    s = splats(spark, d, " ".join(("x y z o r g b", *_Q))).where("chunk_id is not null and record_id is not null and o >= 0 and o <= 1 and abs(x) < 1e6 and abs(y) < 1e6 and abs(z) < 1e6")
    stage = lambda k: F.array(*[F.col(c) * k for c in "rgb"])
    s = s.select(
        "chunk_id", "record_id", "life_start", "life_end", "x", "y", "z", F.array(*_Q).alias("qa"), F.array(*[F.coalesce(F.lead(c).over(w), F.col(c)) for c in _Q]).alias("qb"),
        F.array(F.col("o") * 0.5, F.col("o") * 0.25, F.col("o") * 0.125, F.lit(0.05), F.lit(-0.02)).alias("opacity_stages"), F.pmod("record_id", F.lit(5)).alias("opacity_code"),
        F.array("r", "g", "b").alias("colour_base"), F.array(stage(0.5), stage(-0.25)).alias("colour_stages"),
    )
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    motion = chunks(spark, d).where("chunk_id % 2 = 1").select("chunk_id", lit(_SHIFT).alias("t"), lit(_TURN).alias("q"), F.lit(_SIZE).alias("s"))
    out = E.evaluate_frame(s, motion, 0.25, 5, C0)
    return out.select("chunk_id", "record_id", *[(F.round(c, n) + 0.0).alias(c) for c, n in (*((c, 3) for c in "xyz"), *((c, 5) for c in _Q), ("o", 6), *((c, 5) for c in "rgb"))])


def _coefficients(n: int, scale: float = 0.02):
    return F.array(*[(F.col("qx") * (i + 1) - F.col("qy") * (i * 7 % 5) + F.col("qz")) * (scale / (1 + i)) for i in range(n)])


def summed_harmonics(spark, d):
    """Static harmonics of a record plus its temporal ones, a third of the way to the next record's, without the spare ninth place."""
    w = Window.partitionBy("chunk_id").orderBy("record_id", "splat_id")
    s = splats(spark, d, "qx qy qz").where("chunk_id is not null and record_id is not null").select("splat_id", "chunk_id", "record_id", _coefficients(9).alias("c"))
    s = s.withColumn("n", F.coalesce(F.lead("c").over(w), F.col("c")))
    moving = F.zip_with("c", "n", lambda a, b: a * (2 / 3) + b * (1 / 3))
    both = F.slice(F.zip_with("c", moving, lambda a, b: a + b * 0.5), 1, 8)
    return s.select("splat_id", F.size(both).alias("kept"), (F.round(F.aggregate(both, F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"))


_R = Transform(rotation=(10, 20, 30)).matrix()[:3, :3]


def turned_harmonics(spark, d):
    """Harmonics turned with a rotation: the sum of the three bands, and whether the length of each band is kept."""
    s = splats(spark, d, "qx qy qz").select("splat_id", _coefficients(15).alias("c"))
    s = s.withColumn("t", E.rotate_harmonics(F.col("c"), _R))
    part = lambda c, a, n: F.aggregate(F.slice(c, a + 1, n), F.lit(0.0), lambda x, v: x + v * v)
    kept = F.greatest(*[F.abs(part("c", a, n) - part("t", a, n)) for a, n in ((0, 3), (3, 5), (8, 7))]) < 1e-9
    return s.select("splat_id", (F.round(F.aggregate("t", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"), kept.alias("kept"))


_AFFINE = Transform(rotation=(10, 20, 30), scale=(1.0, 1.5, 0.75)).matrix()[:3, :3]


def projected_harmonics(spark, d):
    """Harmonics under a map that also stretches: their sum, and that of their squares."""
    s = splats(spark, d, "qx qy qz").select("splat_id", E.project_harmonics(_coefficients(15), _AFFINE).alias("t"))
    return s.select("splat_id", (F.round(F.aggregate("t", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"), (F.round(F.aggregate("t", F.lit(0.0), lambda a, v: a + v * v), 6) + 0.0).alias("square"))


def detail_levels(spark, d):
    """How much of a record can be shown: 1 its place, 2 with opacity, colour, size and rotation, 3 with a path of its own as well."""
    s = splats(spark, d, "x y z", "o r g b sx sy sz qx qy qz qw")
    whole = F.lit(True)
    for c in ("o", "r", "g", "b", "sx", "sy", "sz", *_Q):
        whole = whole & F.col(c).isNotNull()
    t = trajectories(spark, d).select("chunk_id", "record_id").distinct().withColumn("path", F.lit(True))
    j = s.join(t, ["chunk_id", "record_id"], "left")
    return j.select("splat_id", F.when(whole & F.coalesce("path", F.lit(False)), 3).when(whole, 2).otherwise(1).alias("level"))


def type_policy(spark, d):
    """What a reader does with each property of a file: reads it, skips one of an unknown type, or refuses the file for one that must be there."""
    from ..operators.drift import TYPE_SPELLINGS, canonical_type

    known = canonical_type(F.col("prop_type")).isin(*sorted(set(TYPE_SPELLINGS.values())))
    p = read(spark, d, "ply_properties").where("file_id is not null and prop_name is not null").groupBy("file_id", "prop_name").agg(F.max(F.coalesce(known, F.lit(False))).alias("known"))
    return p.select("file_id", "prop_name", F.when(F.col("known"), "read").when(F.col("prop_name").isin("x", "y", "z"), "refuse").otherwise("skip").alias("policy"))


def births_log(spark, d):
    """A log of births as tab-separated text, read back and put in the order of its frames."""
    line = F.concat_ws("\t", F.col("interval_no").cast("string"), F.col("chunk_id").cast("string"), F.col("generation").cast("string"))
    log = intervals(spark, d).where("interval_no is not null and chunk_id is not null and generation is not null").select(line.alias("line"))
    b = log.select(F.from_csv("line", "frame bigint, row bigint, generation bigint", {"sep": "\t", "mode": "FAILFAST"}).alias("b")).select("b.*")
    return b.select("frame", "row", "generation", F.row_number().over(Window.partitionBy("frame").orderBy("row")).alias("place"))


def gain_shapes(spark, d):
    """Each path's motion as a gain and the best correlated of four shapes, with its sign."""
    m = [F.col("p")[3 + i].cast("double") - F.col("p")[i % 3].cast("double") for i in range(21)]
    t = trajectories(spark, d).select("vec_id", *[c.alias(f"m{i}") for i, c in enumerate(m)]).where(F.greatest(*[F.abs(f"m{i}") for i in range(21)]) < 1000)
    gain = F.sqrt(sum((F.col(f"m{i}") ** 2 for i in range(21)), F.lit(0.0)))
    dots = [sum((F.col(f"m{i}") * float(v) for i, v in enumerate(a) if v), F.lit(0.0)) for a in E.unit_atoms(8)]
    best = F.array_max(F.array(*[F.struct(F.round(F.abs(x), 6).alias("d"), F.lit(-k).alias("k"), x.alias("w")) for k, x in enumerate(dots)]))
    t = t.withColumn("gain", gain).withColumn("best", best)
    return t.select("vec_id", F.round("gain", 4).alias("gain"), (-F.col("best.k")).alias("shape"), F.when(F.col("best.w") < 0, -1).otherwise(1).alias("sign"), F.round(F.when(F.col("gain") > 0, F.col("best.d") / F.col("gain")).otherwise(0.0), 4).alias("correlation"))


def depth_buffer(spark, d):
    """Records in front, seen along z: not behind the nearest of their own and the eight neighbouring tiles of a tenth by more than 0.3."""
    s = splats(spark, d, "x y z").where("abs(x) < 1e6 and abs(y) < 1e6 and abs(z) < 1e6").select("chunk_id", "splat_id", "z", F.floor(F.col("x") * 10).alias("px"), F.floor(F.col("y") * 10).alias("py"))
    tile = s.groupBy("chunk_id", "px", "py").agg(F.min("z").alias("least"))
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    near = tile.select("chunk_id", "least", "px", "py", moves).select("chunk_id", (F.col("px") + F.col("o.i")).alias("px"), (F.col("py") + F.col("o.j")).alias("py"), "least")
    near = near.groupBy("chunk_id", "px", "py").agg(F.min("least").alias("front"))
    return s.join(near, ["chunk_id", "px", "py"]).select("splat_id", (F.col("z") <= F.col("front") + 0.3).alias("front"))


def colour_levels(spark, d):
    """Red passed through a gain as codes: sixteen quantiles of a chunk, each scaled, and every record at its nearest one (ties to the lower)."""
    s = splats(spark, d, "r").where("chunk_id is not null").select("chunk_id", "splat_id", "r")
    w = Window.partitionBy("chunk_id")
    q = s.withColumn("i", F.row_number().over(w.orderBy("r", "splat_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    q = q.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).where(F.col("i") == F.floor((F.col("k") + 0.5) / 16 * F.col("n"))).groupBy("chunk_id").agg(F.array_sort(F.collect_list("r")).alias("l"))
    best = F.array_min(F.transform("l", lambda v: F.struct(F.abs(F.col("r") - v).alias("d"), v.alias("v"))))
    return s.join(q, "chunk_id").select("splat_id", F.round(best["v"] * 1.189207, 6).alias("r"))


def chroma_harmonics(spark, d):
    """First-band harmonics of the three channels drawn towards their luminance by a tenth."""
    c = [[(F.col(ch) - 0.5) * F.col(q) for q in ("qx", "qy", "qz")] for ch in "rgb"]
    light = [c[0][i] * 0.2126 + c[1][i] * 0.7152 + c[2][i] * 0.0722 for i in range(3)]
    out = [sum((light[i] + (c[k][i] - light[i]) * 0.9 for i in range(3)), F.lit(0.0)) for k in range(3)]
    return splats(spark, d, "r g b qx qy qz").select("splat_id", *[(F.round(v, 6) + 0.0).alias(n) for v, n in zip(out, "rgb")])


def cache_window(spark, d):
    """What a player of a capture holds after each chunk: those up to one behind and two ahead; what arrives, and what leaves."""
    c = chunks(spark, d).where("capture_id is not null and chunk_index is not null").select("capture_id", F.col("chunk_index").cast("bigint").alias("i"), "size_bytes").groupBy("capture_id", "i").agg(F.sum("size_bytes").alias("b"))
    w = Window.partitionBy("capture_id").orderBy("i")
    total = F.sum("b").over(w.rangeBetween(-1, 2))
    came, gone = F.sum("b").over(w.rangeBetween(2, 2)), F.sum("b").over(w.rangeBetween(-2, -2))
    return c.select("capture_id", F.col("i").alias("chunk_index"), F.coalesce(total, F.lit(0)).alias("held"), F.coalesce(came, F.lit(0)).alias("arrives"), F.coalesce(gone, F.lit(0)).alias("leaves"))


def pages_kept(spark, d):
    """Intervals that a mask of layers and a predicate on their sizes let through, counted by chunk; the scan reads no others."""
    i = intervals(spark, d).where((F.pmod("generation", F.lit(3)) != 1) & F.col("stored_size").between(20_000, 120_000))
    return i.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("stored_size").alias("bytes"), F.min("interval_no").alias("first"))


def page_policies(spark, d):
    """The policy of each label, the codec that is cheapest over its intervals, put to every interval of the label."""
    i = intervals(spark, d).where("stored_size is not null").withColumn("label", F.coalesce(F.lower("take_label"), F.lit("")))
    cost = i.groupBy("label").agg(F.sum("stored_size").alias("raw"), F.sum(F.ceil(F.col("stored_size") / 2) + 30_000).alias("packed"))
    policy = cost.select("label", F.when(F.col("raw") <= F.col("packed"), "raw").otherwise("packed").alias("codec"))
    size = F.when(F.col("codec") == "raw", F.col("stored_size")).otherwise(F.ceil(F.col("stored_size") / 2) + 30_000)
    return i.join(policy, "label").groupBy("chunk_id", "codec").agg(F.count(F.lit(1)).alias("pages"), F.sum(size).alias("bytes"))


def joined_groups(spark, d):
    """The groups of a chunk laid end to end as one frame: the row at which each record comes to stand."""
    s = splats(spark, d).where("chunk_id is not null")
    parts = [s.where(F.col("group_no") == k) for k in (1, 2)] + [s.where("group_no is null or group_no not in (1, 2)")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy("chunk_id").orderBy(F.col("group_no").asc_nulls_last(), "record_id", "splat_id")
    return whole.select("splat_id", "chunk_id", (F.row_number().over(w) - 1).alias("row"))


def metadata_report(spark, d):
    """One line per capture as a reader prints it."""
    c = chunks(spark, d).groupBy("capture_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("intervals").alias("ticks"), F.max("splat_count").alias("most"))
    j = captures(spark, d).join(c, "capture_id")
    mode = F.regexp_replace(F.lower(F.trim(F.coalesce("playback_mode", F.lit("unknown")))), "[^a-z]", "")
    text = F.concat(F.lit("capture "), F.col("capture_id").cast("string"), F.lit(": "), F.col("chunks").cast("string"), F.lit(" chunks, "), F.col("ticks").cast("string"), F.lit(" ticks at "), F.col("time_denominator").cast("string"), F.lit("/"), F.col("time_numerator").cast("string"), F.lit(", up to "), F.coalesce(F.col("most").cast("string"), F.lit("?")), F.lit(" records, "), mode)
    return j.select("capture_id", text.alias("line"))


_F = (evaluated_frame, summed_harmonics, turned_harmonics, projected_harmonics, detail_levels, type_policy, births_log, gain_shapes, depth_buffer, colour_levels, chroma_harmonics, cache_window, pages_kept, page_policies, joined_groups, metadata_report)
QUERIES = {f.__name__: f for f in _F}


def _c(n: int) -> str:
    return "[" + ", ".join(f"(qx * {i + 1} - qy * {i * 7 % 5} + qz) * {0.02 / (1 + i)!r}::DOUBLE" for i in range(n)) + "]"


def _turn_sql() -> str:
    out, at = [], 0
    for band in (1, 2, 3):
        m, n = E.harmonics_rotation(_R, band), 2 * band + 1
        out += ["(" + " + ".join(f"c[{at + j + 1}] * {float(m[i, j])!r}::DOUBLE" for j in range(n)) + ")" for i in range(n)]
        at += n
    return "[" + ", ".join(out) + "]"


_X, _Y, _Z, _W = (f"{v!r}::DOUBLE" for v in _TURN)
_IN = "chunk_id IS NOT NULL AND record_id IS NOT NULL"
_P = E.harmonics_projection(_AFFINE)
_PROJECTED = "[" + ", ".join("(" + " + ".join(f"c[{j + 1}] * {float(_P[i, j])!r}::DOUBLE" for j in range(15)) + ")" for i in range(15)) + "]"
_ATOMS = E.unit_atoms(8)
SQL = {
    "projected_harmonics": query(SPLATS("qx qy qz")) + f", c AS (SELECT splat_id, {_c(15)} AS c FROM s), t AS (SELECT splat_id, {_PROJECTED} AS t FROM c) SELECT splat_id, round(list_sum(t), 5) + 0.0 AS total, round(list_sum([v * v for v in t]), 6) + 0.0 AS square FROM t",
    "detail_levels": query(SPLATS("x y z", "o r g b sx sy sz qx qy qz qw"), TRAJECTORIES) + ", t AS (SELECT DISTINCT chunk_id, record_id, true AS path FROM tr) SELECT splat_id, CASE WHEN w AND coalesce(path, false) THEN 3 WHEN w THEN 2 ELSE 1 END AS level FROM (SELECT *, " + " AND ".join(f"{c} IS NOT NULL" for c in ("o", "r", "g", "b", "sx", "sy", "sz", *_Q)) + " AS w FROM s) LEFT JOIN t USING (chunk_id, record_id)",
    "type_policy": """WITH p AS (SELECT file_id, prop_name, max(CASE WHEN lower(trim(prop_type)) IN ('char', 'int8', 'uchar', 'uint8', 'short', 'int16', 'ushort', 'uint16', 'int', 'int32', 'uint', 'uint32', 'float', 'float32', 'double', 'float64') THEN 1 ELSE 0 END) AS known FROM ply_properties WHERE file_id IS NOT NULL AND prop_name IS NOT NULL GROUP BY ALL)
SELECT file_id, prop_name, CASE WHEN known = 1 THEN 'read' WHEN prop_name IN ('x', 'y', 'z') THEN 'refuse' ELSE 'skip' END AS policy FROM p""",
    "births_log": query(INTERVALS) + "SELECT interval_no::BIGINT AS frame, chunk_id AS row, generation::BIGINT AS generation, row_number() OVER (PARTITION BY interval_no ORDER BY chunk_id)::INT AS place FROM iv WHERE interval_no IS NOT NULL AND chunk_id IS NOT NULL AND generation IS NOT NULL",
    "gain_shapes": query(TRAJECTORIES) + ", m AS (SELECT vec_id, [" + ", ".join(f"p[{4 + i}]::DOUBLE - p[{i % 3 + 1}]::DOUBLE" for i in range(21)) + "] AS m FROM tr), k AS (SELECT * FROM m WHERE list_max([abs(v) for v in m]) < 1000), d AS (SELECT vec_id, sqrt(list_sum([v * v for v in m])) AS gain, " + ", ".join("(" + " + ".join(f"m[{i + 1}] * {float(v)!r}::DOUBLE" for i, v in enumerate(a) if v) + f") AS d{j}" for j, a in enumerate(_ATOMS)) + " FROM k), b AS (SELECT *, CASE " + " ".join("WHEN " + " AND ".join(f"round(abs(d{j}), 6) >= round(abs(d{k}), 6)" for k in range(4) if k != j) + f" THEN {j}" for j in range(4)) + " END AS shape FROM d) SELECT vec_id, round(gain, 4) AS gain, shape, CASE WHEN [d0, d1, d2, d3][shape + 1] < 0 THEN -1 ELSE 1 END AS sign, round(CASE WHEN gain > 0 THEN round(abs([d0, d1, d2, d3][shape + 1]), 6) / gain ELSE 0 END, 4) AS correlation FROM b",
    "evaluated_frame": query(SPLATS(" ".join(("x y z o r g b", *_Q))), CHUNKS) + f""", p AS (SELECT chunk_id, record_id, life_start, life_end, x, y, z, o, r, g, b, {", ".join(_Q)}, {", ".join(f"coalesce(lead({c}) OVER w, {c}) AS n{c}" for c in _Q)} FROM s WHERE {_IN} AND o >= 0 AND o <= 1 AND abs(x) < 1e6 AND abs(y) < 1e6 AND abs(z) < 1e6 WINDOW w AS (PARTITION BY chunk_id ORDER BY record_id, splat_id)),
a AS (SELECT *, CASE WHEN {" + ".join(f"{c} * n{c}" for c in _Q)} < 0 THEN -0.25 ELSE 0.25 END::DOUBLE AS v FROM p WHERE life_start <= 5 AND life_end >= 6), l AS (SELECT *, {", ".join(f"{c} * 0.75 + n{c} * v AS m{c}" for c in _Q)} FROM a), n AS (SELECT *, sqrt({" + ".join(f"m{c} * m{c}" for c in _Q)}) AS n FROM l),
u AS (SELECT *, {", ".join(f"CASE WHEN n > 0 THEN m{c} / n ELSE {'1' if c == 'qw' else '0'} END AS u{c}" for c in _Q)}, chunk_id IN (SELECT chunk_id FROM ch WHERE chunk_id % 2 = 1) AS moved FROM n),
t AS (SELECT *, ({_Y} * z - {_Z} * y) * 2 AS tx, ({_Z} * x - {_X} * z) * 2 AS ty, ({_X} * y - {_Y} * x) * 2 AS tz FROM u),
k AS (SELECT *, x + {_W} * tx + ({_Y} * tz - {_Z} * ty) AS vx, y + {_W} * ty + ({_Z} * tx - {_X} * tz) AS vy, z + {_W} * tz + ({_X} * ty - {_Y} * tx) AS vz FROM t)
SELECT chunk_id, record_id, round(CASE WHEN moved THEN vx * 1.5 + 0.5 ELSE x END, 3) + 0.0 AS x, round(CASE WHEN moved THEN vy * 1.5 - 1 ELSE y END, 3) + 0.0 AS y, round(CASE WHEN moved THEN vz * 1.5 + 2 ELSE z END, 3) + 0.0 AS z,
round(CASE WHEN moved THEN {_W}*uqx + {_X}*uqw + {_Y}*uqz - {_Z}*uqy ELSE uqx END, 5) + 0.0 AS qx, round(CASE WHEN moved THEN {_W}*uqy - {_X}*uqz + {_Y}*uqw + {_Z}*uqx ELSE uqy END, 5) + 0.0 AS qy,
round(CASE WHEN moved THEN {_W}*uqz + {_X}*uqy - {_Y}*uqx + {_Z}*uqw ELSE uqz END, 5) + 0.0 AS qz, round(CASE WHEN moved THEN {_W}*uqw - {_X}*uqx - {_Y}*uqy - {_Z}*uqz ELSE uqw END, 5) + 0.0 AS qw,
round(least(1.0, greatest(0.0, o * 0.5 + o * 0.25 + o * 0.125 + 0.05::DOUBLE - 0.02::DOUBLE)) * pow(2, -((record_id % 5 + 5) % 5) / 16.0::DOUBLE), 6) + 0.0 AS o, {", ".join(f"round(0.5::DOUBLE + ({c} + {c} * 0.5 + {c} * -0.25) * {C0!r}::DOUBLE, 5) + 0.0 AS {c}" for c in "rgb")} FROM k""",
    "summed_harmonics": query(SPLATS("qx qy qz")) + f""", c AS (SELECT splat_id, {_c(9)} AS c, chunk_id, record_id FROM s WHERE {_IN}), n AS (SELECT splat_id, c, coalesce(lead(c) OVER (PARTITION BY chunk_id ORDER BY record_id, splat_id), c) AS n FROM c)
SELECT splat_id, 8 AS kept, round(list_sum([c[i] + (c[i] * {2 / 3!r}::DOUBLE + n[i] * {1 / 3!r}::DOUBLE) * 0.5 for i in range(1, 9)]), 5) + 0.0 AS total FROM n""",
    "turned_harmonics": query(SPLATS("qx qy qz")) + f", c AS (SELECT splat_id, {_c(15)} AS c FROM s) SELECT splat_id, round(list_sum({_turn_sql()}), 5) + 0.0 AS total, true AS kept FROM c",
    "depth_buffer": query(SPLATS("x y z")) + """, p AS (SELECT chunk_id, splat_id, z, floor(x * 10) AS px, floor(y * 10) AS py FROM s WHERE abs(x) < 1e6 AND abs(y) < 1e6 AND abs(z) < 1e6), t AS (SELECT chunk_id, px, py, min(z) AS m FROM p GROUP BY ALL),
n AS (SELECT chunk_id, px + i AS px, py + j AS py, min(m) AS front FROM t, range(-1, 2) a(i), range(-1, 2) b(j) GROUP BY ALL) SELECT splat_id, z <= front + 0.3::DOUBLE AS front FROM p JOIN n USING (chunk_id, px, py)""",
    "colour_levels": query(SPLATS("r")) + """, q AS (SELECT chunk_id, r, row_number() OVER (PARTITION BY chunk_id ORDER BY r, splat_id) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM s WHERE chunk_id IS NOT NULL),
l AS (SELECT chunk_id, r AS v FROM q, range(16) k(k) WHERE i = floor((k + 0.5::DOUBLE) / 16 * n)), b AS (SELECT s.splat_id, min({'d': abs(s.r - v), 'v': v}) AS b FROM s JOIN l USING (chunk_id) GROUP BY s.splat_id) SELECT splat_id, round(b.v * 1.189207::DOUBLE, 6) AS r FROM b""",
    "chroma_harmonics": query(SPLATS("r g b qx qy qz")) + ", c AS (SELECT splat_id, (r - 0.5) * (qx + qy + qz) AS r, (g - 0.5) * (qx + qy + qz) AS g, (b - 0.5) * (qx + qy + qz) AS b FROM s), y AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS y FROM c) SELECT splat_id, " + ", ".join(f"round(y + ({c} - y) * 0.9::DOUBLE, 6) + 0.0 AS {c}" for c in "rgb") + " FROM y",
    "cache_window": query(CHUNKS) + """, c AS (SELECT capture_id, chunk_index::BIGINT AS i, sum(size_bytes) AS b FROM ch WHERE capture_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL)
SELECT capture_id, i AS chunk_index, coalesce(sum(b) OVER (w RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING), 0)::BIGINT AS held, coalesce(sum(b) OVER (w RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING), 0)::BIGINT AS arrives, coalesce(sum(b) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING), 0)::BIGINT AS leaves FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY i)""",
    "pages_kept": query(INTERVALS) + "SELECT chunk_id, count(*) AS pages, sum(stored_size)::BIGINT AS bytes, min(interval_no) AS first FROM iv WHERE ((generation % 3) + 3) % 3 <> 1 AND stored_size BETWEEN 20000 AND 120000 GROUP BY chunk_id",
    "page_policies": query(INTERVALS) + """, i AS (SELECT *, coalesce(lower(take_label), '') AS label FROM iv WHERE stored_size IS NOT NULL), c AS (SELECT label, CASE WHEN sum(stored_size) <= sum(ceil(stored_size / 2)::BIGINT + 30000) THEN 'raw' ELSE 'packed' END AS codec FROM i GROUP BY label)
SELECT chunk_id, codec, count(*) AS pages, sum(CASE WHEN codec = 'raw' THEN stored_size ELSE ceil(stored_size / 2)::BIGINT + 30000 END)::BIGINT AS bytes FROM i JOIN c USING (label) GROUP BY ALL""",
    "joined_groups": query(SPLATS()) + "SELECT splat_id, chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY group_no NULLS LAST, record_id, splat_id) - 1)::INT AS row FROM s WHERE chunk_id IS NOT NULL",
    "metadata_report": query(CAPTURES, CHUNKS) + """, c AS (SELECT capture_id, count(*) AS n, sum(intervals) AS t, max(splat_count) AS m FROM ch GROUP BY capture_id)
SELECT capture_id, 'capture ' || capture_id || ': ' || n || ' chunks, ' || t || ' ticks at ' || time_denominator || '/' || time_numerator || ', up to ' || coalesce(m::VARCHAR, '?') || ' records, ' || regexp_replace(lower(trim(coalesce(playback_mode, 'unknown'))), '[^a-z]', '', 'g') AS line FROM cap JOIN c USING (capture_id)""",
}
