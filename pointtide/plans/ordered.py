"""Queries along orderings: runs, spans, fills, deltas, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bits import dequantise, pack, quantise, unpack, unzigzag, zigzag
from ..operators import islands as I
from ..operators import ranking as R
from ..operators.spatial import nearest_level, upper_medians
from ..util import read
from .base import CAPTURES, CHUNKS, INTERVALS, SPLATS, TRAJECTORIES, captures, chunks, intervals, query, splats, trajectories


def identity_segments(spark, d):
    return I.runs(intervals(spark, d), ["chunk_id"], "interval_no", F.col("generation")).select("chunk_id", F.col("run").alias("segment"), F.col("value").alias("generation"), "first", "last", "n")


def visibility_spans(spark, d):
    return I.spans(intervals(spark, d), ["chunk_id"], "interval_no", F.col("stored_size") >= 60000)


def run_length_pack(spark, d):
    return I.id_runs(splats(spark, d, "o").where("o >= 0.3"), ["chunk_id"], "record_id")


def hold_edges(spark, d):
    return I.hold_edges(intervals(spark, d), ["chunk_id"], "interval_no", "take_label", "label").select("chunk_id", "interval_no", "label")


def temporal_delta(spark, d):
    x = I.deltas(intervals(spark, d), ["chunk_id"], "interval_no", "stored_size")
    z = zigzag(F.col("delta"))
    return x.select("chunk_id", "interval_no", "delta", z.alias("zigzag"), unzigzag(z).alias("back"))


def rank_offsets(spark, d):
    x = chunks(spark, d).where("splat_count is not null")
    return I.prefix_offsets(x, ["capture_id"], "chunk_index", "splat_count").select("capture_id", "chunk_id", "splat_count", "offset")


def upper_median(spark, d):
    return upper_medians(intervals(spark, d), ["chunk_id"], "stored_size")


def median_per_chunk(spark, d):
    from ..operators.quantile import grouped_median

    return grouped_median(intervals(spark, d), ["chunk_id"], ["stored_size"]).withColumnRenamed("stored_size", "median")


def truncated_percentile(spark, d):
    return R.truncated_percentile(intervals(spark, d), ["chunk_id"], "stored_size", 0.95)


def trimmed_extent(spark, d):
    s = R.trim_box(splats(spark, d, "y").where("capture_id is not null"), ["capture_id"], ("y",), 0.05)
    return s.groupBy("capture_id").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("kept"))


def trimmed_box(spark, d):
    """The extent of every capture's records that lie within the 0.5 % bounds of all three axes."""
    t = R.trim_box(splats(spark, d, "x y z").select("capture_id", "x", "y", "z"), ["capture_id"])
    return t.groupBy("capture_id").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))], F.count(F.lit(1)).alias("kept"))


def front_to_back_alpha(spark, d):
    t = R.transmittance(splats(spark, d, "z o"), ["chunk_id"], "z", "splat_id", F.col("o") * 0.25)
    return t.select("splat_id", F.round("transmittance", 6).alias("transmittance"), F.round("weight", 6).alias("weight"))


def pick_depth(spark, d):
    """Per chunk the first depth at which less than half of the light is left, else that of the heaviest record."""
    t = R.transmittance(splats(spark, d, "z o"), ["chunk_id"], "z", "splat_id", F.col("o") * 0.25)
    after = F.col("transmittance") * (F.lit(1.0) - F.col("o") * 0.25)
    g = t.groupBy("chunk_id").agg(F.min(F.when(F.round(after, 9) < 0.5, F.col("z"))).alias("half"), F.max_by("z", F.struct(F.round("weight", 9), F.col("splat_id"))).alias("heaviest"))
    return g.select("chunk_id", F.coalesce("half", "heaviest").alias("depth"))


def depth_bins(spark, d):
    return R.depth_bins(splats(spark, d, "z"), ["chunk_id"], "z", 256)


def depth_order(spark, d):
    """Every record's place by depth within its chunk, front to back and, over 65,536 bins, back to front."""
    return R.depth_order(splats(spark, d, "z"), ["chunk_id"], "z", "splat_id")


def systematic_sample(spark, d):
    return R.systematic_sample(splats(spark, d).select("splat_id", "chunk_id"), ["chunk_id"], "splat_id", 10)


def even_frames(spark, d):
    """Seven evenly spread samples of every chunk, and the instants in the middle of its quarters."""
    c = chunks(spark, d).where("intervals is not null")
    pick = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.floor(F.col("intervals") * (i + 0.5) / 7 + 0.5).cast("bigint"))))
    mid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.round((i + 0.5) / 4 * F.col("intervals"), 4))
    return c.select("chunk_id", F.array_join(pick, ",").alias("frames"), F.array_max(mid).alias("last_instant"))


def zorder_rank(spark, d):
    return R.zorder_rank(splats(spark, d, "x y z"), ["chunk_id"], "splat_id", 10)


def latency_median(spark, d):
    """Element n div 2 of the last eight sizes, sorted."""
    w = Window.partitionBy("chunk_id").orderBy("interval_no").rowsBetween(-7, 0)
    last = F.array_sort(F.collect_list("stored_size").over(w))
    return intervals(spark, d).select("chunk_id", "interval_no", F.get(last, F.floor(F.size(last) / 2).cast("int")).alias("median"))


def pack_positions(spark, d):
    """Three 21-bit coordinates in a word and back; whether every coordinate of the chunk comes back within half a step."""
    s = splats(spark, d, "x y z")
    b = s.groupBy("chunk_id").agg(*[f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, 0), (F.max, 1))])
    j = s.join(b, "chunk_id")
    word = pack([(quantise(F.col(a), F.col(f"{a}0"), F.col(f"{a}1"), 21), 21) for a in "xyz"])
    back = unpack(F.col("word"), [21, 21, 21])
    j = j.withColumn("word", word)
    step = lambda a: (F.col(f"{a}1") - F.col(f"{a}0")) / ((1 << 21) - 1)
    err = F.greatest(*[F.when(step(a) > 0, F.abs(dequantise(q, F.col(f"{a}0"), F.col(f"{a}1"), 21) - F.col(a)) / step(a)).otherwise(0.0) for q, a in zip(back, "xyz")])
    return j.groupBy("chunk_id").agg(F.min("word").alias("least"), F.max("word").alias("most"), (F.max(err) <= 0.5 + 1e-6).alias("close"))


def nearest_opacity_level(spark, d):
    levels = [i / 16 for i in range(17)]
    return splats(spark, d, "o").select("splat_id", nearest_level(F.col("o"), levels).alias("lower"), nearest_level(F.col("o"), levels, True).alias("upper"))


def motion_widening(spark, d):
    """Largest step between consecutive samples, and the radius about the first, of every trajectory's capture."""
    p = F.col("p")
    at = lambda i, k: p[3 * i + k].cast("double")
    step = F.greatest(*[F.sqrt(sum(((at(i + 1, k) - at(i, k)) ** 2 for k in range(3)), F.lit(0.0))) for i in range(7)])
    radius = F.greatest(*[F.sqrt(sum(((at(i, k) - at(0, k)) ** 2 for k in range(3)), F.lit(0.0))) for i in range(1, 8)])
    return trajectories(spark, d).groupBy("capture_id").agg(F.round(F.max(step), 5).alias("step"), F.round(F.max(radius), 5).alias("radius"))


def quantised_steps(spark, d):
    """Closed-loop quantised steps of the sizes, in units of 1000."""
    return I.carried_error_steps(intervals(spark, d), ["chunk_id"], "interval_no", "stored_size", 1000.0)


def sequence_discovery(spark, d):
    return I.first_island(read(spark, d, "ply_files"), ["sequence_id"], "frame_no")


def track_groups(spark, d):
    """Chunks by title as tracks: in order of first appearance, and within a track by start."""
    c = chunks(spark, d).join(captures(spark, d).select("capture_id", F.lower(F.trim("title")).alias("track")), "capture_id")
    first = Window.partitionBy("track")
    c = c.withColumn("lead", F.min("chunk_id").over(first))
    return c.select("chunk_id", "track", F.row_number().over(Window.partitionBy("track").orderBy("start_tick", "chunk_id")).alias("place"), "lead")


_F = (identity_segments, visibility_spans, run_length_pack, hold_edges, temporal_delta, rank_offsets, upper_median, median_per_chunk, truncated_percentile, trimmed_extent, trimmed_box, front_to_back_alpha, pick_depth,
      depth_bins, depth_order, systematic_sample, even_frames, zorder_rank, latency_median, pack_positions, nearest_opacity_level, motion_widening, quantised_steps, sequence_discovery, track_groups)
QUERIES = {f.__name__: f for f in _F}

_T = """, t AS (SELECT *, sum(ln(1 - greatest(0, least(1, o * 0.25)))) OVER (PARTITION BY chunk_id ORDER BY z, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM s), u AS (SELECT *, exp(coalesce(l, 0)) AS tm, greatest(0, least(1, o * 0.25)) AS a FROM t)
"""
_Q = "least({m}, greatest(0, floor(CASE WHEN {a}1 > {a}0 THEN ({a} - {a}0) / ({a}1 - {a}0) * {m} ELSE 0 END + 0.5)))::BIGINT"
_BOUNDS = ", b AS (SELECT chunk_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM s GROUP BY chunk_id)"
SQL = {
    "trimmed_box": query(SPLATS("x y z")) + ", r AS (SELECT capture_id, x, y, z, count(*) OVER (PARTITION BY capture_id) AS n, " + ", ".join(f"row_number() OVER (PARTITION BY capture_id ORDER BY {a}) - 1 AS i{a}" for a in "xyz") + " FROM s), e AS (SELECT capture_id, " + ", ".join(f"min({a}) FILTER (i{a} = floor(n * 0.005::DOUBLE)) AS l{a}, max({a}) FILTER (i{a} = n - 1 - floor(n * 0.005::DOUBLE)) AS h{a}" for a in "xyz") + " FROM r GROUP BY capture_id) SELECT s.capture_id, " + ", ".join(f"min({a}) AS low_{a}, max({a}) AS high_{a}" for a in "xyz") + ", count(*) AS kept FROM s JOIN e ON e.capture_id IS NOT DISTINCT FROM s.capture_id WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY s.capture_id",
    "depth_order": query(SPLATS("z")) + """, e AS (SELECT chunk_id, min(z) AS lo, max(z) AS hi FROM s GROUP BY chunk_id), b AS (SELECT s.chunk_id, splat_id, z, CASE WHEN hi > lo THEN floor((hi - z) * (65535.0::DOUBLE / (hi - lo)))::BIGINT ELSE 0 END AS bin FROM s JOIN e USING (chunk_id))
SELECT chunk_id, splat_id, bin, row_number() OVER (PARTITION BY chunk_id ORDER BY z, splat_id) - 1 AS front, row_number() OVER (PARTITION BY chunk_id ORDER BY bin, splat_id) - 1 AS back FROM b""",
    "identity_segments": query(INTERVALS) + """, f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR generation IS DISTINCT FROM lag(generation) OVER w THEN 1 ELSE 0 END AS fresh FROM iv WINDOW w AS (PARTITION BY chunk_id ORDER BY interval_no)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk_id ORDER BY interval_no ROWS UNBOUNDED PRECEDING) AS segment FROM f)
SELECT chunk_id, segment::BIGINT AS segment, min(generation) AS generation, min(interval_no) AS first, max(interval_no) AS last, count(*) AS n FROM g GROUP BY chunk_id, segment""",
    "visibility_spans": query(INTERVALS) + ", g AS (SELECT chunk_id, interval_no, interval_no - row_number() OVER (PARTITION BY chunk_id ORDER BY interval_no) AS i FROM iv WHERE stored_size >= 60000) SELECT chunk_id, min(interval_no)::BIGINT AS first, max(interval_no)::BIGINT + 1 AS \"end\" FROM g GROUP BY chunk_id, i",
    "run_length_pack": query(SPLATS("o")) + ", g AS (SELECT chunk_id, record_id, record_id - row_number() OVER (PARTITION BY chunk_id ORDER BY record_id) AS i FROM (SELECT DISTINCT chunk_id, record_id FROM s WHERE o >= 0.3)) SELECT chunk_id, min(record_id)::BIGINT AS start, count(*) AS length FROM g GROUP BY chunk_id, i",
    "hold_edges": query(INTERVALS) + """SELECT chunk_id, interval_no, coalesce(take_label, last_value(take_label IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY interval_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(take_label IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY interval_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS label FROM iv""",
    "temporal_delta": query(INTERVALS) + ", e AS (SELECT chunk_id, interval_no, stored_size - coalesce(lag(stored_size) OVER (PARTITION BY chunk_id ORDER BY interval_no), 0) AS delta FROM iv) SELECT chunk_id, interval_no, delta, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zigzag, delta AS back FROM e",
    "rank_offsets": query(CHUNKS) + "SELECT capture_id, chunk_id, splat_count, coalesce(sum(splat_count) OVER (PARTITION BY capture_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ch WHERE splat_count IS NOT NULL",
    "upper_median": query(INTERVALS) + ", r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY stored_size) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM iv) SELECT chunk_id, stored_size AS upper_median FROM r WHERE i = n // 2",
    "median_per_chunk": query(INTERVALS) + "SELECT chunk_id, median(stored_size::DOUBLE) AS median FROM iv GROUP BY chunk_id",
    "truncated_percentile": query(INTERVALS) + ", r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY stored_size) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM iv) SELECT chunk_id, stored_size FROM r WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))",
    "trimmed_extent": query(SPLATS("y")) + """, r AS (SELECT capture_id, y, row_number() OVER (PARTITION BY capture_id ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS n FROM s),
e AS (SELECT capture_id, min(y) FILTER (i = floor(n * 0.05::DOUBLE)) AS lo, max(y) FILTER (i = n - 1 - floor(n * 0.05::DOUBLE)) AS hi FROM r GROUP BY capture_id)
SELECT capture_id, min(y) AS low, max(y) AS high, count(*) AS kept FROM s JOIN e USING (capture_id) WHERE y >= lo AND y <= hi GROUP BY capture_id""",
    "front_to_back_alpha": query(SPLATS("z o")) + _T + "SELECT splat_id, round(tm, 6) AS transmittance, round(a * tm, 6) AS weight FROM u",
    "pick_depth": query(SPLATS("z o")) + _T + "SELECT chunk_id, coalesce(min(z) FILTER (round(tm * (1 - a), 9) < 0.5), max_by(z, {'w': round(a * tm, 9), 'k': splat_id})) AS depth FROM u GROUP BY chunk_id",
    "depth_bins": query(SPLATS("z")) + """, e AS (SELECT chunk_id, min(z) AS lo, max(z) AS hi FROM s GROUP BY chunk_id), h AS (SELECT chunk_id, CASE WHEN hi > lo THEN floor((z - lo) * (255.0::DOUBLE / (hi - lo)))::BIGINT ELSE 0 END AS bin, count(*) AS records FROM s JOIN e USING (chunk_id) GROUP BY ALL)
SELECT chunk_id, bin, records, coalesce(sum(records) OVER (PARTITION BY chunk_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h""",
    "systematic_sample": query(SPLATS()) + ", r AS (SELECT splat_id, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY splat_id) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM s) SELECT splat_id, chunk_id FROM r WHERE n <= 10 OR EXISTS (SELECT 1 FROM range(10) k(j) WHERE (j * n) // 10 = i)",
    "even_frames": query(CHUNKS) + ", f AS (SELECT chunk_id, intervals, floor(intervals * (j + 0.5::DOUBLE) / 7 + 0.5)::BIGINT AS k FROM ch, range(7) r(j) WHERE intervals IS NOT NULL) SELECT chunk_id, string_agg(DISTINCT k::VARCHAR, ',' ORDER BY k::VARCHAR) AS frames, round(3.5::DOUBLE / 4 * any_value(intervals), 4) AS last_instant FROM f GROUP BY chunk_id",
    "latency_median": query(INTERVALS) + ", l AS (SELECT chunk_id, interval_no, list(stored_size) OVER (PARTITION BY chunk_id ORDER BY interval_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS v FROM iv) SELECT chunk_id, interval_no, list_sort(v)[len(v) // 2 + 1] AS median FROM l",
    "pack_positions": query(SPLATS("x y z")) + _BOUNDS + f", w AS (SELECT chunk_id, {_Q.format(a='x', m=2097151)} + 2097152 * {_Q.format(a='y', m=2097151)} + 4398046511104 * {_Q.format(a='z', m=2097151)} AS word FROM s JOIN b USING (chunk_id)) SELECT chunk_id, min(word) AS least, max(word) AS most, true AS close FROM w GROUP BY chunk_id",
    "zorder_rank": query(SPLATS("x y z")) + _BOUNDS + f", q AS (SELECT chunk_id, splat_id, {_Q.format(a='x', m=1023)} AS qx, {_Q.format(a='y', m=1023)} AS qy, {_Q.format(a='z', m=1023)} AS qz FROM s JOIN b USING (chunk_id)), m AS (SELECT chunk_id, splat_id, "
    + " + ".join(f"((({c} >> {i}) & 1) << {3 * i + k})" for k, c in enumerate(("qx", "qy", "qz")) for i in range(10)) + " AS morton FROM q) SELECT chunk_id, splat_id, morton, row_number() OVER (PARTITION BY chunk_id ORDER BY morton, splat_id) AS rank FROM m",
    "nearest_opacity_level": query(SPLATS("o")) + "SELECT splat_id, least(16, greatest(0, ceil(o * 16 - 0.5)))::INT AS lower, least(16, greatest(0, floor(o * 16 + 0.5)))::INT AS upper FROM s",
    "motion_widening": query(TRAJECTORIES) + """, st AS (SELECT capture_id, vec_id, max(sqrt((p[3*i+4]::DOUBLE-p[3*i+1])**2 + (p[3*i+5]::DOUBLE-p[3*i+2])**2 + (p[3*i+6]::DOUBLE-p[3*i+3])**2)) AS step,
max(sqrt((p[3*i+4]::DOUBLE-p[1])**2 + (p[3*i+5]::DOUBLE-p[2])**2 + (p[3*i+6]::DOUBLE-p[3])**2)) AS radius FROM tr, range(7) r(i) GROUP BY ALL) SELECT capture_id, round(max(step), 5) AS step, round(max(radius), 5) AS radius FROM st GROUP BY capture_id""",
    "quantised_steps": query(INTERVALS) + ", l AS (SELECT chunk_id, interval_no, floor(stored_size / 1000.0::DOUBLE + 0.5)::BIGINT AS v FROM iv) SELECT chunk_id, interval_no, v - coalesce(lag(v) OVER (PARTITION BY chunk_id ORDER BY interval_no), 0) AS code FROM l",
    "sequence_discovery": "WITH n AS (SELECT DISTINCT sequence_id, frame_no FROM ply_files), g AS (SELECT *, frame_no - row_number() OVER (PARTITION BY sequence_id ORDER BY frame_no) AS i FROM n), f AS (SELECT *, min(i) OVER (PARTITION BY sequence_id) AS m FROM g) SELECT sequence_id, min(frame_no)::BIGINT AS first, max(frame_no)::BIGINT AS last, count(*) AS n FROM f WHERE i = m GROUP BY sequence_id",
    "track_groups": query(CAPTURES, CHUNKS) + ", c AS (SELECT chunk_id, start_tick, lower(trim(title)) AS track FROM ch JOIN cap USING (capture_id)) SELECT chunk_id, track, row_number() OVER (PARTITION BY track ORDER BY start_tick, chunk_id)::INT AS place, min(chunk_id) OVER (PARTITION BY track) AS lead FROM c",
}
SQL["even_frames"] = query(CHUNKS) + ", f AS (SELECT DISTINCT chunk_id, intervals, floor(intervals * (j + 0.5::DOUBLE) / 7 + 0.5)::BIGINT AS k FROM ch, range(7) r(j) WHERE intervals IS NOT NULL) SELECT chunk_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS frames, round(3.5::DOUBLE / 4 * any_value(intervals), 4) AS last_instant FROM f GROUP BY chunk_id"
