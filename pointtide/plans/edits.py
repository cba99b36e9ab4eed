"""Queries on the modifier stack: filters, transforms, colour, pruning, isolation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.colour import C0, colour_matrix, despill, fold_matrices, green_matches, hue, linear_to_srgb, logit, srgb_to_linear
from ..functions.geometry import Transform, apply_affine, apply_linear, quat_multiply, quat_normalise, quat_rotate
from ..functions.timeaxis import keyed, smoothstep, weight_at
from ..operators import modifiers as M
from ..operators.ranking import density_thin, prune_budget
from ..operators.spatial import nth_neighbour_distances, upper_medians
from .base import CAPTURES, SPLATS, captures, chunks, query, splats

#: The scene of the crop queries: captures stand far apart along x, so volumes are wide there.
KEEP = {"shape": "cylinder", "radius": 300.0, "radius_z": 3.5, "height": 2.5, "position": (0.0, -1.0, 1.0)}
DROP = {"shape": "box", "width": 4000.0, "height": 0.5, "depth": 1.0, "position": (0.0, 0.25, 1.5), "remove": True}
POSE = Transform((1.0, 2.0, 3.0), (10.0, 20.0, 30.0), (1.0, 2.0, 0.5), (0.1, 0.0, 0.2))
GRADE = [colour_matrix(exposure=0.5, saturation=0.8), colour_matrix(temperature=1.0, tint=-0.5)]
TURN = (0.18257418583505536, 0.3651483716701107, 0.5477225575051661, 0.7302967433402214)  # 1, 2, 3, 4 made a unit


def _r(c, n=6):
    return F.round(c, n)


def _near(c, n):
    """Rounded, but for numbers so large that their last digit is above that place."""
    return F.when(F.abs(c) < 1e9, F.round(c, n)).otherwise(c)


def crop_keep_remove(spark, d):
    return splats(spark, d, "x y z").where(M.crop_keeps([KEEP, DROP])).select("splat_id")


def crop_statistics(spark, d):
    kept = M.crop_keeps([KEEP, DROP])
    return splats(spark, d, "x y z").groupBy("capture_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


def green_filter(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    return splats(spark, d, "r g b").where(green_matches(*rgb, 0.3, 40.0, False)).select("splat_id")


def hue_of_colours(spark, d):
    return splats(spark, d, "r g b").select("splat_id", _r(hue(F.col("r"), F.col("g"), F.col("b"))).alias("hue"))


def colour_matrix_stack(spark, d):
    m = fold_matrices(GRADE)
    out = apply_linear(m, F.col("r"), F.col("g"), F.col("b"))
    return splats(spark, d, "r g b").select("splat_id", *[_r(c).alias(n) for c, n in zip(out, "rgb")])


def despill_colours(spark, d):
    out = despill(F.col("r"), F.col("g"), F.col("b"))
    return splats(spark, d, "r g b").select("splat_id", *[_r(c).alias(n) for c, n in zip(out, "rgb")])


def srgb_round_trip(spark, d):
    return splats(spark, d, "r g").select("splat_id", _r(srgb_to_linear(F.col("r"))).alias("linear"), _r(linear_to_srgb(srgb_to_linear(F.col("g")))).alias("back"))


def affine_transform(spark, d):
    out = apply_affine(POSE.matrix(), F.col("x"), F.col("y"), F.col("z"))
    return splats(spark, d, "x y z").select("splat_id", *[_r(c, 5).alias(n) for c, n in zip(out, "xyz")])


def rigid_motion(spark, d):
    """Translation, rotation and uniform scale applied to positions, orientations and sizes."""
    q = [F.lit(v) for v in TURN]
    v = quat_rotate(q, [F.col("x"), F.col("y"), F.col("z")])
    turned = quat_multiply(q, quat_normalise([F.col(c) for c in ("qx", "qy", "qz", "qw")]))
    return splats(spark, d, "x y z qx qy qz qw sx").select(
        "splat_id", *[_near(c * 1.5 + t, 5).alias(n) for c, t, n in zip(v, (0.5, -1.0, 2.0), "xyz")], *[_r(c).alias(n) for c, n in zip(turned, ("qx", "qy", "qz", "qw"))], _r(F.col("sx") * 1.5, 8).alias("sx")
    )


def _picks(spark, d):
    """Short-lived records stand for picked ones."""
    return splats(spark, d).where(F.col("life_end") - F.col("life_start") <= 8).select("chunk_id", "record_id")


def erase_antijoin(spark, d):
    return splats(spark, d).join(_picks(spark, d), ["chunk_id", "record_id"], "left_anti").select("splat_id")


def erase_union(spark, d):
    more = splats(spark, d, "", "o").where("o < 0.05").select("chunk_id", "record_id")
    return _picks(spark, d).union(more).distinct()


def mask_intersection(spark, d):
    s = splats(spark, d, "", "x y z o")
    return s.where(M.crop_keeps([KEEP])).select("splat_id").intersect(s.where("o >= 0.5").select("splat_id")).intersect(s.where("is_active").select("splat_id"))


def fade_weights(spark, d):
    ranges = spark.createDataFrame([(1, -1, -1, 0, 0), (2, 10, 40, 5, 0), (3, 0, 30, 3, 4), (4, 20, -1, 0, 6), (5, -1, 25, 4, 4)], "modifier int, start int, end int, fade_in int, fade_out int")
    frames = splats(spark, d).select(F.col("life_start").alias("frame")).union(splats(spark, d).select("life_end")).distinct()
    # a handful of modifiers against the frames in use: the small side is five literal rows
    hit = frames.join(F.broadcast(ranges), ((F.col("start") < 0) | (F.col("frame") >= F.col("start"))) & ((F.col("end") < 0) | (F.col("frame") <= F.col("end"))))
    return hit.select("modifier", "frame", _r(weight_at(F.col("frame"), F.col("start"), F.col("end"), F.col("fade_in"), F.col("fade_out"))).alias("weight"))


_KEYS = [(0, 0.0), (10, 5.0), (25, -2.5), (60, 1.0)]


def keyframe_linear(spark, d):
    return splats(spark, d, "x").select("splat_id", _r(F.col("x") + keyed(F.col("life_start"), _KEYS), 5).alias("x"))


def smooth_fade(spark, d):
    return splats(spark, d, "o").select("splat_id", _r(smoothstep(F.col("life_start") / 30.0)).alias("fade"), _r(F.lit(1.0) - F.pow(F.lit(1.0) - F.least(F.greatest(F.col("o"), F.lit(0.0)), F.lit(1.0)), smoothstep(F.col("life_start") / 30.0))).alias("o"))


def density_thinned(spark, d):
    return density_thin(splats(spark, d, "o"), "record_id", 0.3).select("splat_id", _r(F.col("o")).alias("o"))


def antialias_baked(spark, d):
    scales, o = M.antialias_bake([F.col("sx"), F.col("sy"), F.col("sz")], F.col("o"), M.bake_size())
    return splats(spark, d, "sx sy sz o").select("splat_id", *[_r(c, 8).alias(n) for c, n in zip(scales, ("sx", "sy", "sz"))], _r(o).alias("o"))


def walk_distance(spark, d):
    return captures(spark, d).select("capture_id", _r(F.col("moving_speed") * (F.lit(7.5) - 1.25)).alias("distance"))


def host_pack(spark, d):
    """Rows as a host takes them: dead ones dropped, quaternions w first and of unit length, colours as harmonics."""
    q = quat_normalise([F.col(c) for c in ("qx", "qy", "qz", "qw")])
    s = splats(spark, d, "qx qy qz qw sx sy sz r g b").where("is_active")
    return s.select("splat_id", _r(q[3]).alias("w"), _r(q[0]).alias("i"), _r(q[1]).alias("j"), _r(q[2]).alias("k"), *[F.greatest(F.col(c), F.lit(1e-6)).alias(c) for c in ("sx", "sy", "sz")], *[_r((F.col(c) - 0.5) / C0).alias(f"dc_{c}") for c in "rgb"])


def stored_form(spark, d):
    """The inverse of activation, as PLY files hold records: logit opacity, log scales, harmonics."""
    s = splats(spark, d, "o sx sy sz r g b").where("sx > 0 and sy > 0 and sz > 0")
    return s.select("splat_id", _r(logit(F.col("o"))).alias("opacity"), *[_r(F.ln(c)).alias(f"scale_{i}") for i, c in enumerate(("sx", "sy", "sz"))], *[_r((F.col(c) - 0.5) / C0).alias(f"f_dc_{i}") for i, c in enumerate("rgb")])


def prune_low(spark, d):
    """Two prune filters in a row; the second counts what the first left."""
    s = splats(spark, d, "o sx sy sz").select("splat_id", "chunk_id", "o", (F.col("o") * F.greatest("sx", "sy", "sz")).alias("score"))
    once = prune_budget(s, ["chunk_id"], F.col("score"), "splat_id", 15.0, 0.004)
    return prune_budget(once, ["chunk_id"], F.col("score"), "splat_id", 10.0, 0.002).select("splat_id")


def prune_low_rendered(spark, d):
    """The records that a prune filter on rendered contributions leaves, by its default budget and protection in pixels."""
    length = chunks(spark, d).select("chunk_id", "intervals")
    s = splats(spark, d, "x y z qx qy qz qw sx sy sz o").join(length, "chunk_id", "left")
    return M.Pipeline().add("prune-low-contribution").run(s, 0.0).select("splat_id")


def purge_isolated(spark, d):
    s = splats(spark, d, "x y z").select("splat_id", "chunk_id", "x", "y", "z")
    far = nth_neighbour_distances(s, ["chunk_id"], "splat_id", 4).persist()
    mid = upper_medians(far, ["chunk_id"], "distance")
    return far.join(mid, "chunk_id").where((F.col("upper_median") > 0) & (F.col("distance") > F.col("upper_median") * 1.5)).select("splat_id", _r(F.col("distance")).alias("distance"))


def modifier_pipeline(spark, d):
    """A whole stack at frame 12, compiled to one plan; kept and removed per capture."""
    p = (
        M.Pipeline().add("colour", {"exposure": 0.25, "saturation": 0.9, "opacity": 0.8}, fade_in=20)
        .add("crop", {**KEEP, "keys": [{"frame": 0, "radius": 100.0}, {"frame": 24, "radius": 500.0}]}).add("crop", DROP)
        .add("remove-green", {"minimum_saturation": 0.3, "hue_tolerance": 30.0, "linear": False}).add("erase").add("prune-low-contribution", {"percent": 10.0, "protect_above": 0.005}, start=30)
    )
    s = splats(spark, d, "x y z r g b o", "qx qy qz qw sx sy sz")
    out = p.run(s, 12.0, _picks(spark, d))
    n = s.groupBy("capture_id").agg(F.count(F.lit(1)).alias("before"))
    return n.join(out.groupBy("capture_id").agg(F.count(F.lit(1)).alias("kept"), _r(F.avg("o")).alias("opacity"), _r(F.avg("r")).alias("red")), "capture_id", "left").withColumn("removed", F.col("before") - F.coalesce("kept", F.lit(0)))


#: A stack in which every kind of modifier that changes records acts.
WHOLE_STACK = (
    M.Pipeline().add("prune-low-contribution", {"percent": 10.0, "protect_above": 5.0}).add("erase").add("animate-transform", {"keys": [{"frame": 0, "offset": (0, 0, 0)}, {"frame": 24, "offset": (0.5, 0, 0), "rotation": (0, 2, 0), "scale": (1.0, 1.1, 1.0)}]})
    .add("colour", {"exposure": 0.25, "saturation": 0.9, "opacity": 0.8, "despill": True, "strength": 0.7}, fade_in=20).add("crop", {**KEEP, "keys": [{"frame": 0, "radius": 100.0}, {"frame": 24, "radius": 500.0}]}).add("crop", {**DROP, "height": 1.0, "depth": 3.0})
    .add("remove-green", {"minimum_saturation": 0.3, "hue_tolerance": 30.0, "linear": False}).add("purge-isolated", {"neighbour": 4, "median_percent": 250.0}).add("bake-antialiasing", {"distance": 4.0}).add("walk", {"speed": 0.5}).add("audio").add("loop-morph")
)


def modifier_stack(spark, d):
    """The whole stack at frame 12, record by record."""
    s = splats(spark, d, "x y z qx qy qz qw sx sy sz o r g b").join(chunks(spark, d).select("chunk_id", "intervals"), "chunk_id", "left")
    out = WHOLE_STACK.run(s, 12.0, _picks(spark, d))
    return out.select("splat_id", *[_r(F.col(c), 4).alias(c) for c in ("x", "y", "z", "sx", "sy", "sz", "o", "r", "g", "b")])


_F = (crop_keep_remove, crop_statistics, green_filter, hue_of_colours, colour_matrix_stack, despill_colours, srgb_round_trip, affine_transform, rigid_motion, erase_antijoin, erase_union, mask_intersection,
      fade_weights, keyframe_linear, smooth_fade, density_thinned, antialias_baked, walk_distance, host_pack, stored_form, prune_low, prune_low_rendered, purge_isolated, modifier_pipeline, modifier_stack)
QUERIES = {f.__name__: f for f in _F}

_KEEPS = "(y + 1 >= 0 AND y + 1 <= 2.5 AND x * x / 90000.0::DOUBLE + (z - 1) * (z - 1) / 12.25::DOUBLE <= 1)"
_DROPS = "(y - 0.25 >= 0 AND y - 0.25 <= 0.5 AND abs(x) <= 2000 AND abs(z - 1.5) <= 0.5)"
_HUE = "CASE WHEN greatest(r,g,b) - least(r,g,b) > 0 THEN ((CASE WHEN greatest(r,g,b) = r THEN (g-b)/(greatest(r,g,b)-least(r,g,b)) WHEN greatest(r,g,b) = g THEN (b-r)/(greatest(r,g,b)-least(r,g,b)) + 2 ELSE (r-g)/(greatest(r,g,b)-least(r,g,b)) + 4 END * 60 + 360) % 360) END"


def _lin(m, row, names="rgb", add=0.0):
    return "(" + " + ".join(f"{float(w)!r}::DOUBLE * {n}" for w, n in zip(m[row], names)) + f" + {float(add)!r}::DOUBLE)"


_GR = fold_matrices(GRADE)
_PM = POSE.matrix()
_QN = "sqrt(qx*qx + qy*qy + qz*qz + qw*qw)"


def _kf(f, keys=_KEYS):
    return f"CASE WHEN {f} <= 0 THEN 0.0 WHEN {f} < 10 THEN {f} / 10.0 * 5.0 WHEN {f} < 25 THEN (1 - ({f} - 10) / 15.0) * 5.0 + ({f} - 10) / 15.0 * -2.5 WHEN {f} < 60 THEN (1 - ({f} - 25) / 35.0) * -2.5 + ({f} - 25) / 35.0 * 1.0 ELSE 1.0 END"


_MIX = "((({v} * {k}::HUGEINT) % 4294967296)::BIGINT)"


def _hash_sql(c):
    x1 = _MIX.format(v=f"{c}::HUGEINT", k=0x9E3779B1)
    return x1


_S = M.bake_size()
_ROT = [("x + {w}*tx + ({y}*tz - {z}*ty)"), ("y + {w}*ty + ({z}*tx - {x}*tz)"), ("z + {w}*tz + ({x}*ty - {y}*tx)")]
_T = dict(zip("xyzw", (f"{v!r}::DOUBLE" for v in TURN)))
SQL = {
    "crop_keep_remove": query(SPLATS("x y z")) + f"SELECT splat_id FROM s WHERE {_KEEPS} AND NOT {_DROPS}",
    "crop_statistics": query(SPLATS("x y z")) + f"SELECT capture_id, count(*) FILTER ({_KEEPS} AND NOT {_DROPS}) AS kept, count(*) FILTER (NOT ({_KEEPS} AND NOT {_DROPS})) AS removed FROM s GROUP BY capture_id",
    "green_filter": f"WITH {SPLATS('r g b')}, c AS (SELECT splat_id, greatest(0, least(1, r)) AS r, greatest(0, least(1, g)) AS g, greatest(0, least(1, b)) AS b FROM s), h AS (SELECT *, {_HUE} AS hue FROM c) SELECT splat_id FROM h WHERE greatest(r,g,b) > 0 AND (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b) >= 0.3 AND least(abs(hue - 120), 360 - abs(hue - 120)) <= 40",
    "hue_of_colours": query(SPLATS("r g b")) + f"SELECT splat_id, round({_HUE}, 6) AS hue FROM s",
    "colour_matrix_stack": query(SPLATS("r g b")) + f"SELECT splat_id, round({_lin(_GR, 0)}, 6) AS r, round({_lin(_GR, 1)}, 6) AS g, round({_lin(_GR, 2)}, 6) AS b FROM s",
    "despill_colours": query(SPLATS("r g b")) + f""", h AS (SELECT splat_id, r, g, b, greatest(r,g,b) AS v, CASE WHEN greatest(r,g,b) > 0 THEN (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b) ELSE 0 END AS sat, {_HUE} AS hue FROM s),
k AS (SELECT *, coalesce(hue BETWEEN 60 AND 180, false) AS wedge, sat * (1 - sqrt(greatest(0, 1 - abs(120 - hue) / 60))) AS calm, hue / 60 - floor(hue / 60) AS part, floor(hue / 60) AS sector FROM h),
l AS (SELECT splat_id, sat, CASE WHEN wedge THEN CASE WHEN sector = 1 THEN v * (1 - calm * part) ELSE v * (1 - calm) END ELSE r END AS r, CASE WHEN wedge THEN CASE WHEN sector = 3 THEN v * (1 - calm * part) ELSE v END ELSE g END AS g,
CASE WHEN wedge THEN CASE WHEN sector = 1 THEN v * (1 - calm) WHEN sector = 2 THEN v * (1 - calm * (1 - part)) ELSE v END ELSE b END AS b FROM k),
m AS (SELECT *, g - ((1 - sat) * (r + b) / 2 + sat * greatest(r, b)) AS spill FROM l),
n AS (SELECT *, least(1, r + spill * 0.25) AS r2, least(1, b + spill * 0.25) AS b2 FROM m)
SELECT splat_id, round(CASE WHEN spill > 0 THEN r2 ELSE r END, 6) AS r, round(CASE WHEN spill > 0 THEN (1 - sat) * (r2 + b2) / 2 + sat * greatest(r2, b2) ELSE g END, 6) AS g, round(CASE WHEN spill > 0 THEN b2 ELSE b END, 6) AS b FROM n""",
    "srgb_round_trip": query(SPLATS("r g")) + """, c AS (SELECT splat_id, greatest(0, least(1, r)) AS r, greatest(0, least(1, g)) AS g FROM s)
SELECT splat_id, round(CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END, 6) AS linear, round(g, 6) AS back FROM c""",
    "affine_transform": query(SPLATS("x y z")) + "SELECT splat_id, " + ", ".join(f"round({_lin(_PM[:3, :3], i, 'xyz', _PM[i, 3])}, 5) AS {n}" for i, n in enumerate("xyz")) + " FROM s",
    "rigid_motion": query(SPLATS("x y z qx qy qz qw sx")) + f""", t AS (SELECT *, ({_T['y']}*z - {_T['z']}*y)*2 AS tx, ({_T['z']}*x - {_T['x']}*z)*2 AS ty, ({_T['x']}*y - {_T['y']}*x)*2 AS tz, {_QN} AS n FROM s),
u AS (SELECT *, qx / n AS bx, qy / n AS by_, qz / n AS bz, qw / n AS bw FROM t)
SELECT splat_id, {", ".join(f"CASE WHEN abs(({e.format(**_T)}) * 1.5 + {a}) < 1e9 THEN round(({e.format(**_T)}) * 1.5 + {a}, 5) ELSE ({e.format(**_T)}) * 1.5 + {a} END + 0.0 AS {n}" for e, a, n in zip(_ROT, ("0.5", "-1.0", "2.0"), "xyz"))},
round({_T['w']}*bx + {_T['x']}*bw + {_T['y']}*bz - {_T['z']}*by_, 6) + 0.0 AS qx, round({_T['w']}*by_ - {_T['x']}*bz + {_T['y']}*bw + {_T['z']}*bx, 6) + 0.0 AS qy,
round({_T['w']}*bz + {_T['x']}*by_ - {_T['y']}*bx + {_T['z']}*bw, 6) + 0.0 AS qz, round({_T['w']}*bw - {_T['x']}*bx - {_T['y']}*by_ - {_T['z']}*bz, 6) + 0.0 AS qw, round(sx * 1.5, 8) + 0.0 AS sx FROM u""",
    "erase_antijoin": query(SPLATS()) + "SELECT splat_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.life_end - p.life_start <= 8 AND p.chunk_id = s.chunk_id AND p.record_id = s.record_id)",
    "erase_union": query(SPLATS("", "o")) + "SELECT chunk_id, record_id FROM s WHERE life_end - life_start <= 8 UNION SELECT chunk_id, record_id FROM s WHERE o < 0.05",
    "mask_intersection": query(SPLATS("", "x y z o")) + f"SELECT splat_id FROM s WHERE {_KEEPS} INTERSECT SELECT splat_id FROM s WHERE o >= 0.5 INTERSECT SELECT splat_id FROM s WHERE is_active",
    "fade_weights": query(SPLATS()) + """, f AS (SELECT life_start AS frame FROM s UNION SELECT life_end FROM s), m(modifier, a, e, fi, fo) AS (VALUES (1, -1, -1, 0, 0), (2, 10, 40, 5, 0), (3, 0, 30, 3, 4), (4, 20, -1, 0, 6), (5, -1, 25, 4, 4))
SELECT modifier, frame, round(greatest(0.0, least(1.0, CASE WHEN fi > 0 THEN (frame - greatest(0, a) + 1) / (fi + 1) ELSE 1 END, CASE WHEN fo > 0 AND e >= 0 THEN (e - frame + 1) / (fo + 1) ELSE 1 END))::DOUBLE, 6) AS weight FROM f, m WHERE (a < 0 OR frame >= a) AND (e < 0 OR frame <= e)""",
    "keyframe_linear": query(SPLATS("x")) + f"SELECT splat_id, round(x + ({_kf('life_start')})::DOUBLE, 5) AS x FROM s",
    "smooth_fade": query(SPLATS("o")) + ", t AS (SELECT splat_id, least(greatest(o, 0.0), 1.0) AS o, least(1, greatest(0, life_start / 30.0::DOUBLE)) AS c FROM s) SELECT splat_id, round(c * c * (3 - 2 * c), 6) AS fade, round(1 - pow(1 - o, c * c * (3 - 2 * c)), 6) AS o FROM t",
    "density_thinned": query(SPLATS("o")) + f""", h1 AS (SELECT splat_id, o, ((record_id::HUGEINT * {0x9E3779B1}) % 4294967296)::BIGINT AS h FROM s),
h2 AS (SELECT splat_id, o, ((xor(h, h >> 16)::HUGEINT * {0x85EBCA6B}) % 4294967296)::BIGINT AS h FROM h1), h3 AS (SELECT splat_id, o, ((xor(h, h >> 13)::HUGEINT * {0xC2B2AE35}) % 4294967296)::BIGINT AS h FROM h2)
SELECT splat_id, round(1 - pow(greatest(0, 1 - o), {1 / 0.3!r}::DOUBLE), 6) AS o FROM h3 WHERE xor(h, h >> 16) < {int(0.3 * 4294967296)}""",
    "antialias_baked": query(SPLATS("sx sy sz o")) + f""", g AS (SELECT *, sqrt(sx*sx + {_S * _S!r}::DOUBLE) AS gx, sqrt(sy*sy + {_S * _S!r}::DOUBLE) AS gy, sqrt(sz*sz + {_S * _S!r}::DOUBLE) AS gz FROM s),
q AS (SELECT *, sx / gx AS a, sy / gy AS b_, sz / gz AS c FROM g)
SELECT splat_id, round(gx, 8) AS sx, round(gy, 8) AS sy, round(gz, 8) AS sz, round(o * CASE WHEN least(a, b_, c) > 0 THEN a * b_ * c / least(a, b_, c) ELSE greatest(a * b_, a * c, b_ * c) END, 6) AS o FROM q""",
    "walk_distance": query(CAPTURES) + "SELECT capture_id, round(moving_speed * 6.25, 6) AS distance FROM cap",
    "host_pack": query(SPLATS("qx qy qz qw sx sy sz r g b")) + f"SELECT splat_id, round(qw / {_QN}, 6) + 0.0 AS w, round(qx / {_QN}, 6) + 0.0 AS i, round(qy / {_QN}, 6) + 0.0 AS j, round(qz / {_QN}, 6) + 0.0 AS k, greatest(sx, 1e-6) AS sx, greatest(sy, 1e-6) AS sy, greatest(sz, 1e-6) AS sz, " + ", ".join(f"round(({c} - 0.5) / {C0!r}::DOUBLE, 6) + 0.0 AS dc_{c}" for c in "rgb") + " FROM s WHERE is_active",
    "stored_form": query(SPLATS("o sx sy sz r g b")) + f"SELECT splat_id, round(ln(greatest(1e-6, least({1 - 1e-6!r}::DOUBLE, o)) / (1 - greatest(1e-6, least({1 - 1e-6!r}::DOUBLE, o)))), 6) AS opacity, round(ln(sx), 6) AS scale_0, round(ln(sy), 6) AS scale_1, round(ln(sz), 6) AS scale_2, " + ", ".join(f"round(({c} - 0.5) / {C0!r}::DOUBLE, 6) AS f_dc_{i}" for i, c in enumerate("rgb")) + " FROM s WHERE sx > 0 AND sy > 0 AND sz > 0",
    "prune_low": query(SPLATS("o sx sy sz")) + """, a AS (SELECT splat_id, chunk_id, o * greatest(sx, sy, sz) AS score FROM s),
a1 AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n, CASE WHEN score >= 0 AND score < 0.004 THEN row_number() OVER (PARTITION BY chunk_id, score >= 0 AND score < 0.004 ORDER BY score, splat_id) END AS k FROM a),
b1 AS (SELECT splat_id, chunk_id, score FROM a1 WHERE k IS NULL OR k > floor(n * 0.15::DOUBLE)),
a2 AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n, CASE WHEN score >= 0 AND score < 0.002 THEN row_number() OVER (PARTITION BY chunk_id, score >= 0 AND score < 0.002 ORDER BY score, splat_id) END AS k FROM b1)
SELECT splat_id FROM a2 WHERE k IS NULL OR k > floor(n * 0.1::DOUBLE)""",
    "purge_isolated": query(SPLATS("x y z")) + """, p AS (SELECT a.chunk_id, a.splat_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM s a JOIN s b ON a.chunk_id = b.chunk_id AND a.splat_id <> b.splat_id),
n AS (SELECT chunk_id, splat_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY dist) AS k FROM p) WHERE k = 4),
m AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY dist) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS c FROM n),
u AS (SELECT chunk_id, dist AS mid FROM m WHERE i = c // 2)
SELECT splat_id, round(dist, 6) AS distance FROM n JOIN u USING (chunk_id) WHERE mid > 0 AND dist > mid * 1.5""",
}
_W = 13 / 21
_PC = fold_matrices([colour_matrix(exposure=0.25 * _W, saturation=1 - 0.1 * _W)])
_KEEP12 = _KEEPS.replace("90000.0", "90000.0")
SQL["modifier_pipeline"] = query(SPLATS("x y z r g b o", "qx qy qz qw sx sy sz")) + f""", e AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.life_end - p.life_start <= 8 AND p.chunk_id = s.chunk_id AND p.record_id = s.record_id)),
c AS (SELECT *, {_lin(_PC, 0)} AS r1, {_lin(_PC, 1)} AS g1, {_lin(_PC, 2)} AS b1 FROM e WHERE (y + 1 >= 0 AND y + 1 <= 2.5 AND x * x / 90000.0::DOUBLE + (z - 1) * (z - 1) / 12.25::DOUBLE <= 1) AND NOT {_DROPS}),
k AS (SELECT capture_id, o, r1, greatest(0, least(1, r1)) AS r, greatest(0, least(1, g1)) AS g, greatest(0, least(1, b1)) AS b FROM c), h AS (SELECT *, {_HUE} AS hue FROM k),
f AS (SELECT * FROM h WHERE NOT coalesce(greatest(r,g,b) > 0 AND (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b) >= 0.3 AND least(abs(hue - 120), 360 - abs(hue - 120)) <= 30, false)),
t AS (SELECT capture_id, count(*) AS kept, round(avg(o * {1 - 0.2 * _W!r}::DOUBLE), 6) AS opacity, round(avg(r1), 6) AS red FROM f GROUP BY capture_id), n AS (SELECT capture_id, count(*) AS before FROM s GROUP BY capture_id)
SELECT capture_id, before, kept, opacity, red, before - coalesce(kept, 0) AS removed FROM n LEFT JOIN t USING (capture_id)"""
