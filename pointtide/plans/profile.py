"""Queries on storage, dictionaries, joins and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bits import mix_u32
from ..operators import profile as P
from ..operators.spatial import components, local_planes
from ..util import join_null_safe, read
from .base import CAPTURES, CHUNKS, INTERVALS, SPLATS, captures, chunks, intervals, query, splats


def page_cost_report(spark, d):
    return P.costs(intervals(spark, d).withColumn("label", F.lower("take_label")), "label", "generation", "stored_size")


def dictionary_compaction(spark, d):
    return P.compact_dictionary(intervals(spark, d), ["chunk_id"], "generation")


def frequency_table(spark, d):
    return P.normalised_frequencies(intervals(spark, d).where("take_label is not null"), ["chunk_id"], "take_label", 4096)


def directory_digest(spark, d):
    text = F.concat_ws("|", F.col("chunk_id"), F.col("start_tick"), F.col("intervals"))
    return P.ordered_digest(chunks(spark, d).where("capture_id is not null"), ["capture_id"], "chunk_id", text)


def cheapest_codec(spark, d):
    """Per capture the cheapest of three ways to store a chunk: whole, per interval, or in runs of four; the second is not to be had
    for chunks of unknown size."""
    c = chunks(spark, d).where("intervals is not null")
    made = c.select("capture_id", F.explode(F.array(
        F.struct(F.lit("whole").alias("codec"), (F.col("splat_count") * 40 + F.col("intervals") * 900).alias("cost")),
        F.struct(F.lit("each").alias("codec"), F.when(F.col("size_bytes").isNotNull(), F.col("splat_count") * F.col("intervals")).alias("cost")),
        F.struct(F.lit("runs").alias("codec"), (F.col("splat_count") * F.ceil(F.col("intervals") / 4) * 5).alias("cost")),
    )).alias("o")).select("capture_id", "o.codec", "o.cost")
    return P.cheapest(made, ["capture_id"], "codec", "cost")


def codec_policy(spark, d):
    """Codec of each label so that work is least within one part in a hundred of the smallest size; the table of sums is small."""
    rows = intervals(spark, d).where("take_label is not null").groupBy(F.lower("take_label").alias("label")).agg(F.sum("stored_size").alias("b")).orderBy("label").collect()
    options = {r["label"]: [("raw", int(r["b"] * 1.02), 1.0), ("packed", int(r["b"] * 1.004), 2.0), ("coded", int(r["b"]), 5.0)] for r in rows}
    return spark.createDataFrame(sorted(P.pareto_choice(options).items()), "label string, codec string")


def size_estimate(spark, d):
    return P.size_estimate(intervals(spark, d), ["chunk_id"], "interval_no", "stored_size")


def palette_check(spark, d):
    return P.palette(splats(spark, d, "r g b"), ["chunk_id"], ["r", "g", "b"], 64)


def fit_check(spark, d):
    """Quantised positions against the originals, with records of low opacity missing on one side and of high on the other."""
    s = splats(spark, d, "x y z o")
    made = s.where("o < 0.95").select("splat_id", *[(F.rint(F.col(a) * 256) / 256).alias(a) for a in "xyz"])
    f = P.compare_fit(made, s.where("o > 0.05"), "splat_id", ["x", "y", "z"])
    return f.select("shown", "missing", "stray", F.round("rms", 8).alias("rms"), F.round("worst", 8).alias("worst"))


def kmeans_centres(spark, d):
    out = P.weighted_kmeans(splats(spark, d, "r g b o"), ["r", "g", "b"], "o", _START, 3)
    return spark.createDataFrame([(i, *[round(float(v), 6) for v in c]) for i, c in enumerate(out)], "centre int, r double, g double, b double")


def optional_default(spark, d):
    """Optional attributes joined, with defaults where they are missing."""
    own = captures(spark, d).select("capture_id", "moving_speed", "tags")
    return chunks(spark, d).join(own, "capture_id", "left").select("chunk_id", F.coalesce("moving_speed", F.lit(0.0)).alias("moving_speed"), F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags"))


def tag_index(spark, d):
    t = captures(spark, d).select("capture_id", F.explode("tags").alias("t")).select("capture_id", F.lower(F.trim("t")).alias("tag")).where("tag != ''").distinct()
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("captures"), F.min("capture_id").alias("first"))


def scatter_assign(spark, d):
    """Points take one of eight variants by a hash of their id, with a phase of its own, and are counted per variant and phase."""
    s = splats(spark, d).select("splat_id", F.pmod(mix_u32(F.col("splat_id")), F.lit(8)).alias("variant"))
    v = spark.range(8).select(F.col("id").alias("variant"), F.round(F.pmod(F.lit(0.1) + F.col("id") / 8 * 0.75, F.lit(1.0)), 6).alias("phase"))
    return s.join(F.broadcast(v), "variant").groupBy("variant", "phase").agg(F.count(F.lit(1)).alias("copies"), F.min("splat_id").alias("first"))


def distinct_instants(spark, d):
    """Instants asked for, once each: copies share what is computed for their key."""
    ask = splats(spark, d).select("capture_id", F.round(F.col("life_start") / 30.0, 6).alias("seconds"))
    return ask.groupBy("capture_id", "seconds").agg(F.count(F.lit(1)).alias("copies"))


def dead_reference_check(spark, d):
    """Records whose chunk is unknown, or whose life runs past it."""
    s = splats(spark, d).join(chunks(spark, d).select("chunk_id", "intervals"), "chunk_id", "left")
    return s.where(F.col("intervals").isNull() | (F.col("life_end") > F.col("intervals")) | (F.col("life_start") < 0)).select("splat_id", "chunk_id")


def touching_components(spark, d):
    return components(splats(spark, d, "x y z"), ["chunk_id"], "splat_id", 0.05, 3)


def plane_normals(spark, d):
    return local_planes(splats(spark, d, "x y z o"), ["chunk_id"], "splat_id")


def unpaired_keys(spark, d):
    """Captures and chunks that lack each other, from both sides."""
    c = captures(spark, d).select("capture_id").withColumn("known", F.lit(True))
    k = chunks(spark, d).groupBy("capture_id").agg(F.count(F.lit(1)).alias("chunks"))
    return c.join(k, "capture_id", "full_outer")


def label_ranks(spark, d):
    """Ranks of the intervals of each label by size, through counts per size: the window is over a label's different sizes, not its rows."""
    i = intervals(spark, d).select("chunk_id", "interval_no", F.lower("take_label").alias("label"), "stored_size").where("label is not null")
    n = i.groupBy("label", "stored_size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label")
    by = w.orderBy(F.desc("stored_size"))
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.when(F.sum("n").over(w) > 1, before / (F.sum("n").over(w) - 1)).otherwise(0.0)
    n = n.select("label", "stored_size", (before + 1).cast("int").alias("rank"), F.row_number().over(by).alias("dense"), F.round(share, 6).alias("share"))
    return join_null_safe(i, n, ["label", "stored_size"]).select("chunk_id", "interval_no", "rank", "dense", "share")


def cube_of_sizes(spark, d):
    return intervals(spark, d).withColumn("label", F.lower("take_label")).cube("label", "generation").agg(F.count(F.lit(1)).alias("n"), F.max("stored_size").alias("most"))


def event_windows(spark, d):
    """Six-hour windows of the events, tumbling."""
    e = read(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_sessions(spark, d):
    """Sessions of each user: events no more than half a day apart."""
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    fresh = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") >= F.lag("ts").over(w) + F.expr("interval 12 hours")), 1).otherwise(0)
    s = e.withColumn("f", fresh).withColumn("session", F.sum("f").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, d, "events").groupBy("event_type", F.floor(k / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def sort_limit(spark, d):
    """The twenty largest intervals of the corpus, a report."""
    return intervals(spark, d).orderBy(F.desc("stored_size"), "chunk_id", "interval_no").limit(20).select("chunk_id", "interval_no", "stored_size")


_F = (page_cost_report, dictionary_compaction, frequency_table, directory_digest, cheapest_codec, codec_policy, size_estimate, palette_check, fit_check, kmeans_centres, optional_default, tag_index, scatter_assign,
      distinct_instants, dead_reference_check, touching_components, plane_normals, unpaired_keys, label_ranks, cube_of_sizes, event_windows, event_sessions, json_props, sort_limit)
QUERIES = {f.__name__: f for f in _F}



def _kmeans_sql(start, rounds):
    sql = query(SPLATS("r g b o")) + ", c0(k, r, g, b) AS (VALUES " + ", ".join(f"({i}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for i, c in enumerate(start)) + ")"
    for i in range(rounds):
        sql += f""", a{i} AS (SELECT s.r, s.g, s.b, o, k FROM s, c{i} c QUALIFY row_number() OVER (PARTITION BY splat_id ORDER BY (s.r-c.r)**2 + (s.g-c.g)**2 + (s.b-c.b)**2, k) = 1), c{i + 1} AS (SELECT k, sum(r*o)/sum(o) AS r, sum(g*o)/sum(o) AS g, sum(b*o)/sum(o) AS b FROM a{i} GROUP BY k)"""
    return sql + f" SELECT k AS centre, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c{rounds}"


_START = [[0.2, 0.2, 0.2], [0.5, 0.5, 0.5], [0.8, 0.8, 0.8], [0.9, 0.2, 0.2]]
SQL = {
    # all ways to choose, which are few for the labels at hand
    "codec_policy": query(INTERVALS).replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT lower(take_label) AS label, sum(stored_size) AS b FROM iv WHERE take_label IS NOT NULL GROUP BY ALL), l AS (SELECT label, b, row_number() OVER (ORDER BY label) AS i FROM b),
o AS (SELECT i, label, 'raw' AS codec, floor(b::DOUBLE * 1.02::DOUBLE)::BIGINT AS size, 1 AS work FROM l UNION ALL SELECT i, label, 'packed', floor(b::DOUBLE * 1.004::DOUBLE)::BIGINT, 2 FROM l UNION ALL SELECT i, label, 'coded', b::BIGINT, 5 FROM l),
w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS size, 0 AS work, []::VARCHAR[] AS picks UNION ALL SELECT o.i, w.size + o.size, w.work + o.work, list_append(picks, codec) FROM w JOIN o ON o.i = w.i + 1),
t AS (SELECT picks FROM w WHERE i = (SELECT max(i) FROM l) AND size <= (SELECT sum(b) FROM l) * 1.01::DOUBLE ORDER BY work, size LIMIT 1) SELECT label, picks[i] AS codec FROM l, t""",
    "kmeans_centres": _kmeans_sql(_START, 3),
    "touching_components": query(SPLATS("x y z")).replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT splat_id AS k, chunk_id, x, y, z, floor(x / 0.0501) AS cx, floor(y / 0.0501) AS cy, floor(z / 0.0501) AS cz FROM s), o AS (SELECT i FROM (VALUES (-1), (0), (1)) v(i)),
m AS (SELECT c.*, cx + a.i AS nx, cy + e.i AS ny, cz + f.i AS nz FROM c, o a, o e, o f),
e AS (SELECT m.k AS a, c.k AS b FROM m JOIN c ON m.chunk_id = c.chunk_id AND m.nx = c.cx AND m.ny = c.cy AND m.nz = c.cz WHERE m.k <> c.k AND (m.x-c.x)*(m.x-c.x) + (m.y-c.y)*(m.y-c.y) + (m.z-c.z)*(m.z-c.z) <= 0.05::DOUBLE * 0.05::DOUBLE),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), l AS (SELECT a AS splat_id, min(b) AS component FROM reach GROUP BY a)
SELECT splat_id, component FROM l QUALIFY count(*) OVER (PARTITION BY component) >= 3""",
    "page_cost_report": query(INTERVALS) + "SELECT lower(take_label) AS label, generation, sum(stored_size)::BIGINT AS bytes, count(*) AS rows, grouping(lower(take_label), generation) AS level, round(sum(stored_size) / (SELECT sum(stored_size) FROM iv), 6) AS share FROM iv GROUP BY GROUPING SETS ((lower(take_label), generation), (lower(take_label)), (generation), ())",
    "dictionary_compaction": query(INTERVALS) + "SELECT chunk_id, generation, count(*) AS uses, row_number() OVER (PARTITION BY chunk_id ORDER BY generation) - 1 AS code FROM iv WHERE generation IS NOT NULL GROUP BY chunk_id, generation",
    "frequency_table": query(INTERVALS) + """, n AS (SELECT chunk_id, take_label, count(*) AS n FROM iv WHERE take_label IS NOT NULL GROUP BY ALL), f AS (SELECT *, greatest(1, floor(n * 4096 / sum(n) OVER (PARTITION BY chunk_id))) AS f FROM n),
r AS (SELECT *, 4096 - sum(f) OVER (PARTITION BY chunk_id) AS rest, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, take_label) AS k FROM f) SELECT chunk_id, take_label, (f + CASE WHEN k = 1 THEN rest ELSE 0 END)::BIGINT AS frequency FROM r""",
    "directory_digest": query(CHUNKS) + ", e AS (SELECT capture_id, chunk_id, sha256(concat_ws('|', chunk_id, start_tick, intervals)) AS h FROM ch WHERE capture_id IS NOT NULL) SELECT capture_id, sha256(string_agg(h, '' ORDER BY chunk_id)) AS digest FROM e GROUP BY capture_id",
    "cheapest_codec": query(CHUNKS) + """, o AS (SELECT capture_id, 'whole' AS codec, splat_count * 40 + intervals * 900 AS cost FROM ch WHERE intervals IS NOT NULL UNION ALL SELECT capture_id, 'each', CASE WHEN size_bytes IS NOT NULL THEN splat_count * intervals END FROM ch WHERE intervals IS NOT NULL
UNION ALL SELECT capture_id, 'runs', splat_count * ceil(intervals / 4)::BIGINT * 5 FROM ch WHERE intervals IS NOT NULL), t AS (SELECT capture_id, codec, sum(cost)::BIGINT AS cost FROM o GROUP BY ALL HAVING count(*) = count(cost))
SELECT capture_id, codec, cost FROM t QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY cost, codec) = 1""",
    "palette_check": query(SPLATS("r g b")) + "SELECT chunk_id, count(DISTINCT (r, g, b)) AS \"distinct\", count(DISTINCT (r, g, b)) <= 64 AS exact FROM s GROUP BY chunk_id",
    "size_estimate": query(INTERVALS) + """, i AS (SELECT chunk_id, stored_size, row_number() OVER (PARTITION BY chunk_id ORDER BY interval_no) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM iv), k AS (SELECT *, least(4, ceil(n / 8))::BIGINT AS k FROM i), t AS (SELECT *, (i * k) // n AS slot FROM k),
w AS (SELECT chunk_id, slot, sum(stored_size) AS s, count(*) AS c, any_value(n) AS n FROM t WHERE i - ceil(slot * n / k) < 8 GROUP BY chunk_id, slot) SELECT chunk_id, round(sum(s) / sum(c) * any_value(n), 3) AS estimate, max(s)::BIGINT AS peak FROM w GROUP BY chunk_id""",
    "fit_check": query(SPLATS("x y z o")) + """, m AS (SELECT splat_id, round_even(x * 256, 0) / 256 AS mx, round_even(y * 256, 0) / 256 AS my, round_even(z * 256, 0) / 256 AS mz FROM s WHERE o < 0.95::DOUBLE), w AS (SELECT * FROM s WHERE o > 0.05::DOUBLE),
j AS (SELECT m.splat_id AS a, w.splat_id AS b, (x-mx)**2 + (y-my)**2 + (z-mz)**2 AS q FROM m FULL JOIN w ON m.splat_id = w.splat_id)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shown, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (b IS NULL) AS stray, round(sqrt(avg(q)), 8) AS rms, round(sqrt(max(q)), 8) AS worst FROM j""",
    "optional_default": query(CAPTURES, CHUNKS) + "SELECT chunk_id, coalesce(moving_speed, 0.0) AS moving_speed, coalesce(len(tags), 0)::INT AS n_tags FROM ch LEFT JOIN cap USING (capture_id)",
    "tag_index": query(CAPTURES) + ", t AS (SELECT DISTINCT capture_id, lower(trim(t)) AS tag FROM (SELECT capture_id, unnest(tags) AS t FROM cap) WHERE trim(t) <> '') SELECT tag, count(*) AS captures, min(capture_id) AS first FROM t GROUP BY tag",
    "scatter_assign": query(SPLATS()) + f""", h1 AS (SELECT splat_id, (((splat_id & 4294967295)::HUGEINT * {0x9E3779B1}) % 4294967296)::BIGINT AS h FROM s),
h2 AS (SELECT splat_id, ((xor(h, h >> 16)::HUGEINT * {0x85EBCA6B}) % 4294967296)::BIGINT AS h FROM h1), h3 AS (SELECT splat_id, ((xor(h, h >> 13)::HUGEINT * {0xC2B2AE35}) % 4294967296)::BIGINT AS h FROM h2), v AS (SELECT splat_id, xor(h, h >> 16) % 8 AS variant FROM h3)
SELECT variant, round((0.1::DOUBLE + variant / 8 * 0.75::DOUBLE) % 1.0, 6) AS phase, count(*) AS copies, min(splat_id) AS first FROM v GROUP BY variant""",
    "distinct_instants": query(SPLATS()) + "SELECT capture_id, round(life_start / 30.0::DOUBLE, 6) AS seconds, count(*) AS copies FROM s GROUP BY ALL",
    "dead_reference_check": query(SPLATS(), CHUNKS) + "SELECT splat_id, chunk_id FROM s LEFT JOIN ch USING (chunk_id) WHERE intervals IS NULL OR life_end > intervals OR life_start < 0",
    "unpaired_keys": query(CAPTURES, CHUNKS) + ", k AS (SELECT capture_id, count(*) AS chunks FROM ch GROUP BY capture_id), c AS (SELECT capture_id, true AS known FROM cap) SELECT capture_id, known, chunks FROM c FULL JOIN k USING (capture_id)",
    "label_ranks": query(INTERVALS) + "SELECT chunk_id, interval_no, rank() OVER w::INT AS rank, dense_rank() OVER w::INT AS dense, round(percent_rank() OVER w, 6) AS share FROM iv WHERE take_label IS NOT NULL WINDOW w AS (PARTITION BY lower(take_label) ORDER BY stored_size DESC)",
    "cube_of_sizes": query(INTERVALS) + "SELECT lower(take_label) AS label, generation, count(*) AS n, max(stored_size) AS most FROM iv GROUP BY CUBE (lower(take_label), generation)",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f) SELECT user_id, session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL",
    "json_props": "WITH e AS (SELECT event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events) SELECT event_type, floor(k / 10)::BIGINT AS bucket, count(*) AS n, sum(k)::BIGINT AS total FROM e GROUP BY ALL",
    "sort_limit": query(INTERVALS) + "SELECT chunk_id, interval_no, stored_size FROM iv ORDER BY stored_size DESC, chunk_id, interval_no LIMIT 20",
}
