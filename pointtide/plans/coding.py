"""Queries on codes, pages and orders: half precision, opacities, normals, harmonics, coverage, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes as N
from ..functions.bits import mix_u32
from ..functions.geometry import quat_normalise
from ..operators import islands as I
from ..operators.evaluate import budget_segments
from ..util import read
from .base import CAPTURES, CHUNKS, INTERVALS, SPLATS, captures, chunks, intervals, query, splats


def half_round_trip(spark, d):
    """Positions in half precision: the number, its 16 bits, and their rank among all codes."""
    h = splats(spark, d, "x").select("splat_id", N.half(F.col("x")).alias("h"))
    bits = F.when(F.abs("h") < float("inf"), N.half_bits(F.col("h")))
    return h.select("splat_id", F.when(F.abs("h") < float("inf"), F.col("h")).alias("half"), bits.alias("bits"), N.half_rank(bits).alias("rank"))


def opacity_codes(spark, d):
    s = splats(spark, d, "o").select("splat_id", N.opacity_code(F.col("o")).alias("code"))
    return s.select("splat_id", "code", F.round(N.opacity_of(F.col("code")), 6).alias("back"))


def normal_codes(spark, d):
    """The vector part of the rotation stands for a direction; its code, and what that decodes to."""
    axes = N.ranked_axes([F.col(c) for c in ("sx", "sy", "sz")])
    s = splats(spark, d, "qx qy qz sx sy sz").withColumn("axes", axes)
    u, v = N.normal_code([F.col(c) for c in ("qx", "qy", "qz")], F.col("axes"))
    s = s.select("splat_id", "axes", u.alias("u"), v.alias("v"))
    return s.select("splat_id", "u", "v", *[(F.round(c, 5) + 0.0).alias(n) for c, n in zip(N.normal_of(F.col("u"), F.col("v"), F.col("axes")), "xyz")])


def _harmonics():
    """Fifteen coefficients made of a rotation; those of a higher degree are smaller."""
    return F.array(*[(F.col("qx") * (i + 1) - F.col("qy") * (i * 7 % 5) + F.col("qz")) * (0.02 / (1 + i)) for i in range(15)])


def harmonics_degrees(spark, d):
    """The least degree within a tolerance, the coefficients cut to it and grown back to degree 2, of which the spare ninth place is 0."""
    s = splats(spark, d, "qx qy qz").select("splat_id", _harmonics().alias("c")).withColumn("degree", N.least_degree(F.col("c"), 0.006))
    cut = F.when(F.col("degree") == 0, N.to_degree(F.col("c"), 0)).when(F.col("degree") == 1, N.to_degree(F.col("c"), 1)).when(F.col("degree") == 2, N.to_degree(F.col("c"), 2)).otherwise(F.col("c"))
    two = F.concat(N.to_degree(cut, 2), F.array(F.lit(0.0)))
    total = F.aggregate(two, F.lit(0.0), lambda a, v: a + v)
    return s.select("splat_id", "degree", F.size(cut).alias("kept"), F.size(two).alias("slots"), (F.round(total, 6) + 0.0).alias("total"))


def wide_split(spark, d):
    v = F.col("stored_size")
    high, low = N.split_wide(v, 8)
    return intervals(spark, d).where("stored_size >= 0").select("chunk_id", "interval_no", high.alias("symbol"), low.alias("low"), N.join_wide(high, low, 8).alias("back"))


def page_coverage(spark, d):
    """Per capture and chunk how far its bytes start behind the end of those before: 0 is right, more is a gap, less an overlap."""
    w = Window.partitionBy("capture_id").orderBy("file_offset", "chunk_id")
    c = chunks(spark, d).where("file_offset is not null and size_bytes is not null")
    off = F.col("file_offset") - F.lag(F.col("file_offset") + F.col("size_bytes")).over(w)
    return c.select("capture_id", "chunk_id", off.alias("off"), F.when(off > 0, "gap").when(off < 0, "overlap").otherwise("joined").alias("state"))


def layer_order(spark, d):
    """Intervals in the order of their layers (the generation modulo 3), stable within a layer."""
    i = intervals(spark, d).where("generation is not null").withColumn("layer", F.pmod("generation", F.lit(3)))
    return i.select("chunk_id", "interval_no", "layer", F.row_number().over(Window.partitionBy("chunk_id").orderBy("layer", "interval_no")).alias("place"))


def first_and_gaps(spark, d):
    """The distinct generations of a chunk as the first and the gaps that follow."""
    g = intervals(spark, d).where("generation is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set("generation")).alias("g"))
    gaps = F.zip_with(F.slice(F.col("g"), 2, F.size("g")), F.slice(F.col("g"), 1, F.size("g") - 1), lambda a, b: a - b)
    return g.select("chunk_id", F.get("g", F.lit(0)).alias("first"), F.array_join(gaps.cast("array<string>"), ",").alias("gaps"))


def row_context(spark, d):
    """Context of each interval by the one before: none, or whether that rose, fell or held, and in which generation."""
    w = Window.partitionBy("chunk_id").orderBy("interval_no")
    before, two = F.lag("stored_size", 1).over(w), F.lag("stored_size", 2).over(w)
    kind = F.when(before.isNull(), 0).when(two.isNull(), 1).when(before > two, 2).when(before < two, 3).otherwise(4)
    return intervals(spark, d).select("chunk_id", "interval_no", (kind + F.when(F.col("generation") == F.lag("generation").over(w), 0).otherwise(8)).alias("context"))


def prepare_progress(spark, d):
    """Which part of a capture's bytes is at hand after each chunk."""
    w = Window.partitionBy("capture_id")
    c = chunks(spark, d).where("size_bytes > 0 and capture_id is not null")
    done = F.sum("size_bytes").over(w.orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("capture_id", "chunk_id", F.round(done / F.sum("size_bytes").over(w), 9).alias("done"))


def cache_rank(spark, d):
    """In which order a player at the middle chunk gives up chunks: the farthest first, of equally far ones those behind."""
    w = Window.partitionBy("capture_id")
    c = chunks(spark, d).where("chunk_index is not null and capture_id is not null").withColumn("at", F.floor(F.max("chunk_index").over(w) / 2))
    far = F.abs(F.col("chunk_index") - F.col("at")) * 2 + F.when(F.col("chunk_index") < F.col("at"), 1).otherwise(0)
    return c.select("capture_id", "chunk_id", F.row_number().over(w.orderBy(far.desc(), "chunk_id")).alias("leaves"))


def request_order(spark, d):
    """Requests of a player at 3 seconds, nearest deadline first; what is past comes last."""
    due = F.col("start_seconds") - 3.0
    c = chunks(spark, d).where("start_seconds is not null and capture_id is not null")
    return c.select("capture_id", "chunk_id", F.row_number().over(Window.partitionBy("capture_id").orderBy((due < 0), F.abs(due), "chunk_id")).alias("turn"))


def capped_work(spark, d):
    """Intervals cut where the generation changes, after 48 of them, and before their sizes pass a budget."""
    return budget_segments(intervals(spark, d).where("stored_size is not null"), ["chunk_id"], "interval_no", "generation", "stored_size", 48, 2_000_000)


def split_records(spark, d):
    """Each stretch of large intervals becomes a record of its own, numbered within its chunk; a chunk without any has one empty record."""
    s = I.spans(intervals(spark, d), ["chunk_id"], "interval_no", F.col("stored_size") >= 60000)
    every = intervals(spark, d).select("chunk_id").where("chunk_id is not null").distinct().join(s, "chunk_id", "left")
    part = F.row_number().over(Window.partitionBy("chunk_id").orderBy("first")) - 1
    return every.select("chunk_id", part.alias("record"), F.coalesce("first", F.lit(0)).alias("life_start"), F.coalesce("end", F.lit(0)).alias("life_end"))


def runs_as_base64(spark, d):
    """The runs of a chunk's record numbers as text, and that as base64."""
    r = I.id_runs(splats(spark, d), ["chunk_id"], "record_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))), ",")
    return r.select("chunk_id", F.base64(F.encode(text, "utf-8")).alias("packed"), F.length(text).alias("chars"))


def capture_uuid(spark, d):
    """A custom (version 8) uuid from the digest of a capture's chunks in their order."""
    text = F.concat_ws("|", "chunk_id", "start_tick", "intervals")
    c = chunks(spark, d).where("capture_id is not null").groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", text.alias("t")))).alias("c"))
    h = F.sha2(F.array_join(F.transform("c", lambda x: x["t"]), ";"), 256)
    c = c.select("capture_id", h.alias("h"))
    digit = F.substring(F.lit("89ab"), F.conv(F.substring("h", 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return c.select("capture_id", F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.concat(F.lit("8"), F.substring("h", 14, 3)), F.concat(digit, F.substring("h", 18, 3)), F.substring("h", 21, 12)).alias("uuid"))


def inferred_timebase(spark, d):
    """The rational of each capture's seconds a tick: over 1 if that reproduces it, else over 1001, else as it is stated."""
    s = F.col("time_numerator") / F.col("time_denominator")
    one, ntsc = F.floor(F.lit(1.0) / s + 0.5), F.floor(F.lit(1001.0) / s + 0.5)
    fits = lambda n, k: (k >= 1) & (F.abs(F.lit(n) / k - s) <= s * 1e-9)
    kind = F.when(fits(1.0, one), 1).when(fits(1001.0, ntsc), 1001).otherwise(F.col("time_numerator"))
    den = F.when(fits(1.0, one), one).when(fits(1001.0, ntsc), ntsc).otherwise(F.col("time_denominator"))
    return captures(spark, d).select("capture_id", kind.cast("bigint").alias("numerator"), den.cast("bigint").alias("denominator"))


def scatter_variants(spark, d):
    """Copies of every record's chunk: one of eight variants, its phase, and a speed that the seed jitters by up to a fifth."""
    h = mix_u32(F.col("splat_id"))
    v = F.pmod(h, F.lit(8))
    jitter = mix_u32(F.col("splat_id") + 77777) / 4294967296.0
    return splats(spark, d).select("splat_id", v.alias("variant"), F.round(F.pmod(F.lit(0.1) + v / 8 * 0.75, F.lit(1.0)), 6).alias("phase"), F.round(F.lit(1.0) + (jitter * 2 - 1) * 0.2, 6).alias("speed"))


def attribute_precedence(spark, d):
    """The label that holds for an interval: its own, else its chunk's first, else its capture's title; and which of them it is."""
    i = intervals(spark, d)
    first = i.where("take_label is not null").groupBy("chunk_id").agg(F.min_by("take_label", "interval_no").alias("chunk_label"))
    names = chunks(spark, d).select("chunk_id", "capture_id").join(captures(spark, d).select("capture_id", "title"), "capture_id", "left").select("chunk_id", "title")
    j = i.join(first, "chunk_id", "left").join(names, "chunk_id", "left")
    level = F.when(F.col("take_label").isNotNull(), 0).when(F.col("chunk_label").isNotNull(), 1).when(F.col("title").isNotNull(), 2)
    return j.select("chunk_id", "interval_no", F.coalesce("take_label", "chunk_label", "title").alias("label"), level.alias("level"))


def morph_frames(spark, d):
    """The frames of a loop morph behind each chunk, and how far each has gone: as many as a third of the chunk."""
    n = F.greatest(F.lit(1), F.floor(F.col("intervals") / 3)).cast("int")
    c = chunks(spark, d).where("intervals > 0").select("chunk_id", (F.col("start_tick") + F.col("intervals")).alias("last"), n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    return c.select("chunk_id", (F.col("last") + F.col("k")).alias("frame"), F.round(F.col("k") / (F.col("n") + 1), 9).alias("part"))


def manifest_labels(spark, d):
    """The manifest of each sequence written as JSON and read back: the label of each frame, and where it changes."""
    from ..sources.ply import chunk_labels

    f = read(spark, d, "ply_files").where("sequence_id is not null and frame_no is not null").groupBy("sequence_id", "frame_no").agg(F.min("capture_id").alias("c"))
    frame = F.struct(F.col("frame_no").cast("bigint").alias("frame"), F.concat(F.lit("part-"), F.floor(F.col("frame_no") / 5)).alias("chunk"))
    j = f.groupBy("sequence_id").agg(F.to_json(F.struct(F.collect_list(frame).alias("frames"))).alias("json"))
    return chunk_labels(j, "json", ["sequence_id"])


_F = (half_round_trip, opacity_codes, normal_codes, harmonics_degrees, wide_split, page_coverage, layer_order, first_and_gaps, row_context, prepare_progress, cache_rank, request_order, capped_work, split_records,
      runs_as_base64, capture_uuid, inferred_timebase, scatter_variants, attribute_precedence, morph_frames, manifest_labels)
QUERIES = {f.__name__: f for f in _F}


def _mix(v: str) -> str:
    """mix_u32 as SQL."""
    out = f"((({v}) & 4294967295)::HUGEINT * {0x9E3779B1} % 4294967296)::BIGINT"
    for shift, k in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = f"((xor({out}, {out} >> {shift}))::HUGEINT * {k} % 4294967296)::BIGINT"
    return f"xor({out}, {out} >> 16)"


_AXES = "list_sort([{'s': sx, 'i': 0}, {'s': sy, 'i': 1}, {'s': sz, 'i': 2}])"
_C15 = "[" + ", ".join(f"(qx * {i + 1} - qy * {i * 7 % 5} + qz) * {0.02 / (1 + i)!r}::DOUBLE" for i in range(15)) + "]"
SQL = {
    "half_round_trip": query(SPLATS("x")) + """, a AS (SELECT splat_id, x, abs(x) AS a, floor(log2(nullif(abs(x), 0)))::INT AS f FROM s),
e AS (SELECT *, greatest(-14, f + CASE WHEN pow(2, f + 1) <= a THEN 1 WHEN pow(2, f) > a THEN -1 ELSE 0 END) AS e FROM a),
h AS (SELECT splat_id, CASE WHEN a = 0 THEN 0.0 WHEN a < 65520 THEN sign(x) * floor(a / pow(2, e - 10) + 0.5) * pow(2, e - 10) END AS h FROM e),
g AS (SELECT splat_id, h, abs(h) AS a, floor(log2(nullif(abs(h), 0)))::INT AS f FROM h),
k AS (SELECT *, greatest(-14, f + CASE WHEN pow(2, f + 1) <= a THEN 1 WHEN pow(2, f) > a THEN -1 ELSE 0 END) AS e FROM g),
w AS (SELECT *, round(a / pow(2, e - 10))::INT AS w FROM k), b AS (SELECT splat_id, h, (CASE WHEN a = 0 THEN 0 WHEN w < 1024 THEN w ELSE (e + 15) * 1024 + w - 1024 END + CASE WHEN h < 0 THEN 32768 ELSE 0 END)::INT AS bits FROM w)
SELECT splat_id, h AS half, bits, CASE WHEN bits >= 32768 THEN 65535 - bits ELSE bits + 32768 END AS rank FROM b""",
    "opacity_codes": query(SPLATS("o")) + ", c AS (SELECT splat_id, CASE WHEN o > 0 THEN least(255, floor(log2(least(o, 1)) * -16 + 0.5)::INT) ELSE 255 END AS code FROM s) SELECT splat_id, code, round(pow(2, -code / 16.0::DOUBLE), 6) AS back FROM c",
    "normal_codes": query(SPLATS("qx qy qz sx sy sz")) + f""", a AS (SELECT splat_id, [qx, qy, qz] AS v, [t.i for t in {_AXES}] AS x FROM s), p AS (SELECT splat_id, x, v[x[1] + 1] AS z, v[x[2] + 1] AS a, v[x[3] + 1] AS b FROM a),
q AS (SELECT *, abs(a) + abs(b) + abs(z) AS n FROM p),
c AS (SELECT splat_id, x, CASE WHEN n > 0 THEN greatest(0, least(255, floor(((a + b) / n + 1) * 0.5 * 255 + 0.5)))::INT ELSE 128 END AS u, CASE WHEN n > 0 THEN (greatest(0, least(127, floor(((a - b) / n + 1) * 0.5 * 127 + 0.5)))::INT * 2 + CASE WHEN z < 0 THEN 1 ELSE 0 END) ELSE 128 END AS v FROM q),
e AS (SELECT *, u / 255.0::DOUBLE * 2 - 1 AS f, (v // 2) / 127.0::DOUBLE * 2 - 1 AS g FROM c), m AS (SELECT *, (f + g) * 0.5 AS px, (f - g) * 0.5 AS py FROM e),
k AS (SELECT *, greatest(0, 1 - abs(px) - abs(py)) * CASE WHEN v % 2 = 1 THEN -1 ELSE 1 END AS pz FROM m), o AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM k)
SELECT splat_id, u, v, """ + ", ".join(f"round(CASE list_position(x, {i}) WHEN 1 THEN pz WHEN 2 THEN px ELSE py END / n, 5) + 0.0 AS {n}" for i, n in enumerate("xyz")) + " FROM o",
    "harmonics_degrees": query(SPLATS("qx qy qz")) + f""", c AS (SELECT splat_id, {_C15} AS c FROM s), q AS (SELECT *, """ + ", ".join(f"sqrt(list_sum([v * v for v in c[{n + 1}:15]]) / 15) AS m{k}" for k, n in enumerate(N.HARMONICS[:3])) + """ FROM c),
g AS (SELECT *, CASE WHEN m0 <= 0.006::DOUBLE THEN 0 WHEN m1 <= 0.006::DOUBLE THEN 1 WHEN m2 <= 0.006::DOUBLE THEN 2 ELSE 3 END AS degree FROM q), k AS (SELECT *, [0, 3, 8, 15][degree + 1] AS kept FROM g)
SELECT splat_id, degree, kept, 9 AS slots, round(coalesce(list_sum(c[1:least(kept, 8)]), 0.0), 6) + 0.0 AS total FROM k""",
    "wide_split": query(INTERVALS) + "SELECT chunk_id, interval_no, stored_size >> 8 AS symbol, stored_size & 255 AS low, stored_size AS back FROM iv WHERE stored_size >= 0",
    "page_coverage": query(CHUNKS) + """, o AS (SELECT capture_id, chunk_id, file_offset - lag(file_offset + size_bytes) OVER (PARTITION BY capture_id ORDER BY file_offset, chunk_id) AS off FROM ch WHERE file_offset IS NOT NULL AND size_bytes IS NOT NULL)
SELECT *, CASE WHEN off > 0 THEN 'gap' WHEN off < 0 THEN 'overlap' ELSE 'joined' END AS state FROM o""",
    "layer_order": query(INTERVALS) + ", l AS (SELECT chunk_id, interval_no, ((generation % 3) + 3) % 3 AS layer FROM iv WHERE generation IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY layer, interval_no)::INT AS place FROM l",
    "first_and_gaps": query(INTERVALS) + ", g AS (SELECT DISTINCT chunk_id, generation AS g FROM iv WHERE generation IS NOT NULL), d AS (SELECT chunk_id, g, g - lag(g) OVER (PARTITION BY chunk_id ORDER BY g) AS gap FROM g) SELECT chunk_id, min(g) AS first, coalesce(string_agg(gap::VARCHAR, ',' ORDER BY g), '') AS gaps FROM d GROUP BY chunk_id",
    "row_context": query(INTERVALS) + """, w AS (SELECT chunk_id, interval_no, generation AS g, lag(generation) OVER o AS h, lag(stored_size) OVER o AS a, lag(stored_size, 2) OVER o AS b FROM iv WINDOW o AS (PARTITION BY chunk_id ORDER BY interval_no))
SELECT chunk_id, interval_no, CASE WHEN a IS NULL THEN 0 WHEN b IS NULL THEN 1 WHEN a > b THEN 2 WHEN a < b THEN 3 ELSE 4 END + CASE WHEN g = h THEN 0 ELSE 8 END AS context FROM w""",
    "prepare_progress": query(CHUNKS) + "SELECT capture_id, chunk_id, round(sum(size_bytes) OVER (PARTITION BY capture_id ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) / sum(size_bytes) OVER (PARTITION BY capture_id), 9) AS done FROM ch WHERE size_bytes > 0 AND capture_id IS NOT NULL",
    "cache_rank": query(CHUNKS) + """, a AS (SELECT *, floor(max(chunk_index) OVER (PARTITION BY capture_id) / 2) AS mid FROM ch WHERE chunk_index IS NOT NULL AND capture_id IS NOT NULL)
SELECT capture_id, chunk_id, row_number() OVER (PARTITION BY capture_id ORDER BY abs(chunk_index - mid) * 2 + CASE WHEN chunk_index < mid THEN 1 ELSE 0 END DESC, chunk_id)::INT AS leaves FROM a""",
    "request_order": query(CHUNKS) + "SELECT capture_id, chunk_id, row_number() OVER (PARTITION BY capture_id ORDER BY (start_seconds - 3.0::DOUBLE) < 0, abs(start_seconds - 3.0::DOUBLE), chunk_id)::INT AS turn FROM ch WHERE start_seconds IS NOT NULL AND capture_id IS NOT NULL",
    "capped_work": query(INTERVALS).replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT chunk_id, interval_no AS i, generation AS g, stored_size AS v, row_number() OVER (PARTITION BY chunk_id ORDER BY interval_no) AS k FROM iv WHERE stored_size IS NOT NULL),
w AS (SELECT chunk_id, k, i, g, 1 AS part, 1 AS n, v::BIGINT AS total FROM r WHERE k = 1
UNION ALL SELECT r.chunk_id, r.k, r.i, r.g, CASE WHEN t THEN part + 1 ELSE part END, CASE WHEN t THEN 1 ELSE n + 1 END, CASE WHEN t THEN r.v ELSE total + r.v END FROM (SELECT w.*, q.v AS nv, q.g AS ng, (q.g IS DISTINCT FROM w.g OR n >= 48 OR total + q.v > 2000000) AS t FROM w JOIN r q ON q.chunk_id = w.chunk_id AND q.k = w.k + 1) w JOIN r ON r.chunk_id = w.chunk_id AND r.k = w.k + 1)
SELECT chunk_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*) AS n, max(total)::BIGINT AS total FROM w GROUP BY chunk_id, part""",
    "split_records": query(INTERVALS) + """, g AS (SELECT chunk_id, interval_no AS i, interval_no - row_number() OVER (PARTITION BY chunk_id ORDER BY interval_no) AS k FROM iv WHERE stored_size >= 60000), s AS (SELECT chunk_id, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY chunk_id, k),
e AS (SELECT DISTINCT chunk_id FROM iv WHERE chunk_id IS NOT NULL) SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY a) - 1)::INT AS record, coalesce(a, 0)::BIGINT AS life_start, coalesce(b, 0)::BIGINT AS life_end FROM e LEFT JOIN s USING (chunk_id)""",
    "runs_as_base64": query(SPLATS()) + """, g AS (SELECT chunk_id, record_id AS i, record_id - row_number() OVER (PARTITION BY chunk_id ORDER BY record_id) AS k FROM (SELECT DISTINCT chunk_id, record_id FROM s WHERE record_id IS NOT NULL)), r AS (SELECT chunk_id, min(i) AS a, count(*) AS n FROM g GROUP BY chunk_id, k),
t AS (SELECT chunk_id, string_agg(a::VARCHAR || '+' || n::VARCHAR, ',' ORDER BY a) AS t FROM r GROUP BY chunk_id) SELECT chunk_id, to_base64(encode(t)) AS packed, length(t)::INT AS chars FROM t""",
    "capture_uuid": query(CHUNKS) + """, h AS (SELECT capture_id, sha256(string_agg(concat_ws('|', chunk_id, start_tick, intervals), ';' ORDER BY chunk_id)) AS h FROM ch WHERE capture_id IS NOT NULL GROUP BY capture_id)
SELECT capture_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
    "inferred_timebase": query(CAPTURES) + """, s AS (SELECT *, time_numerator / time_denominator AS s FROM cap), k AS (SELECT *, floor(1 / s + 0.5) AS a, floor(1001 / s + 0.5) AS b FROM s), f AS (SELECT *, a >= 1 AND abs(1 / a - s) <= s * 1e-9 AS p, b >= 1 AND abs(1001 / b - s) <= s * 1e-9 AS q FROM k)
SELECT capture_id, (CASE WHEN p THEN 1 WHEN q THEN 1001 ELSE time_numerator END)::BIGINT AS numerator, (CASE WHEN p THEN a WHEN q THEN b ELSE time_denominator END)::BIGINT AS denominator FROM f""",
    "scatter_variants": query(SPLATS()) + f", h AS (SELECT splat_id, {_mix('splat_id')} AS h, {_mix('splat_id + 77777')} AS j FROM s) SELECT splat_id, h % 8 AS variant, round((0.1::DOUBLE + (h % 8) / 8 * 0.75::DOUBLE) % 1.0, 6) AS phase, round(1 + (j / 4294967296.0::DOUBLE * 2 - 1) * 0.2::DOUBLE, 6) AS speed FROM h",
    "attribute_precedence": query(INTERVALS, CHUNKS, CAPTURES) + """, f AS (SELECT chunk_id, min_by(take_label, interval_no) AS l FROM iv WHERE take_label IS NOT NULL GROUP BY chunk_id), n AS (SELECT chunk_id, title FROM ch LEFT JOIN cap USING (capture_id))
SELECT chunk_id, interval_no, coalesce(take_label, l, title) AS label, CASE WHEN take_label IS NOT NULL THEN 0 WHEN l IS NOT NULL THEN 1 WHEN title IS NOT NULL THEN 2 END AS level FROM iv LEFT JOIN f USING (chunk_id) LEFT JOIN n USING (chunk_id)""",
    "morph_frames": query(CHUNKS) + ", n AS (SELECT chunk_id, start_tick + intervals AS last, greatest(1, intervals // 3) AS n FROM ch WHERE intervals > 0) SELECT chunk_id, last + k AS frame, round(k / (n + 1), 9) AS part FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n)",
    "manifest_labels": """WITH f AS (SELECT DISTINCT sequence_id, frame_no::BIGINT AS frame, 'part-' || (frame_no // 5) AS chunk FROM ply_files WHERE sequence_id IS NOT NULL AND frame_no IS NOT NULL)
SELECT *, lag(frame) OVER w IS NULL OR chunk IS DISTINCT FROM lag(chunk) OVER w AS fresh FROM f WINDOW w AS (PARTITION BY sequence_id ORDER BY frame)""",
}
