"""Queries that run as streams, and on raw vertex lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.identity import run_to_table, track_identities, windowed_counts
from ..util import read

GAP = 12 * 3600


def _epoch():
    """Seconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def _events(spark, d):
    """The events as a stream of files, a few at a time."""
    kinds = read(spark, d, "events").schema
    return spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 4).parquet(d)


def identity_stream(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("key"), _epoch().alias("at"), F.col("event_type").alias("mark"))
    last = lambda t: t.groupBy("key", "generation").agg(F.max_by(F.struct("first", "last", "mark", "n"), "batch").alias("s"))
    return run_to_table(spark, track_identities(s, GAP), "update", last).where("generation > 0").select("key", "generation", "s.first", "s.last", "s.mark", "s.n")


def window_stream(spark, d):
    last = lambda t: t.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    out = run_to_table(spark, windowed_counts(_events(spark, d).withColumn("ts", F.timestamp_seconds(_epoch())), "ts", "1 day", "2 days", ["event_type"]), "update", last)
    return out.select(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(start))").alias("start"), "event_type", "n")


def ply_positions(spark, d):
    """Coordinates of every vertex line, by the places that its file's header gives them."""
    p = read(spark, d, "ply_properties").where("prop_name in ('x', 'y', 'z')").groupBy("file_id").agg(*[F.min(F.when(F.col("prop_name") == a, F.col("ordinal"))).alias(f"at_{a}") for a in "xyz"])
    v = read(spark, d, "ply_vertices").where("line is not null").select("file_id", "row_no", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("w"))
    cell = lambda a: F.get("w", F.col(f"at_{a}")).try_cast("double")
    return v.join(p, "file_id").select("file_id", "row_no", *[cell(a).alias(a) for a in "xyz"]).groupBy("file_id", "row_no").agg(*[F.min(a).alias(a) for a in "xyz"])


_F = (identity_stream, window_stream, ply_positions)
QUERIES = {f.__name__: f for f in _F}
SQL = {
    "identity_stream": f"""WITH e AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS tick, event_type AS mark FROM events), f AS (SELECT *, CASE WHEN lag(tick) OVER w IS NULL OR mark <> lag(mark) OVER w OR tick - lag(tick) OVER w > {GAP} THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY key ORDER BY tick, mark)),
g AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY tick, mark ROWS UNBOUNDED PRECEDING)::BIGINT AS generation FROM f) SELECT key, generation, min(tick) AS first, max(tick) AS last, min(mark) AS mark, count(*) AS n FROM g GROUP BY key, generation""",
    "window_stream": "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "ply_positions": """WITH p AS (SELECT file_id, min(ordinal) FILTER (prop_name = 'x') AS ax, min(ordinal) FILTER (prop_name = 'y') AS ay, min(ordinal) FILTER (prop_name = 'z') AS az FROM ply_properties WHERE prop_name IN ('x', 'y', 'z') GROUP BY file_id),
v AS (SELECT file_id, row_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS w FROM ply_vertices WHERE line IS NOT NULL)
SELECT file_id, row_no, min(TRY_CAST(w[ax + 1] AS DOUBLE)) AS x, min(TRY_CAST(w[ay + 1] AS DOUBLE)) AS y, min(TRY_CAST(w[az + 1] AS DOUBLE)) AS z FROM v JOIN p USING (file_id) GROUP BY file_id, row_no""",
}
