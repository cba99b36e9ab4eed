"""Cleaned views that the queries share, as DataFrames and as SQL. Repeated rows count once; of the splats a query gets the numbers that it
names, and leaves out a record only where one of these is missing or not finite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import finite, read

_PARTS = [("positions", ("x", "y", "z")), ("rotation", ("qx", "qy", "qz", "qw")), ("scales", ("sx", "sy", "sz")), ("color_dc", ("r", "g", "b"))]
_PLAIN = ["splat_id", "capture_id", "chunk_id", "record_id", "group_no", "life_start", "life_end", "is_active"]
_PLACE = {"o": ("opacity", None)} | {p: (n, i) for n, ps in _PARTS for i, p in enumerate(ps)}


def splats(spark, d, reads: str = "", may: str = "") -> DataFrame:
    """Keys, lives and the named numbers of the splats: those of ``reads``, without which a record has no part in the query, and those of
    ``may``, which are null where they are missing or not finite. The scan reads nothing else."""
    s, cols = read(spark, d, "splats"), []
    for p in [*reads.split(), *may.split()]:
        name, i = _PLACE[p]
        c = F.col(name).cast("double") if i is None else F.get(F.col(name), F.lit(i)).cast("double")
        cols.append((c if p in reads.split() else F.when(finite(c), c)).alias(p))
        if p in reads.split():
            s = s.where(finite(c))  # before the shuffle, in which repeated rows meet at their key
    return s.select(*_PLAIN, *cols).dropDuplicates(["splat_id"])


def SPLATS(reads: str = "", may: str = "") -> str:
    """The same view, as SQL."""
    raw = lambda p: _PLACE[p][0] + ("" if _PLACE[p][1] is None else f"[{_PLACE[p][1] + 1}]")
    cols = [f"{raw(p)}::DOUBLE AS {p}" for p in reads.split()] + [f"CASE WHEN isfinite({raw(p)}) THEN {raw(p)}::DOUBLE END AS {p}" for p in may.split()]
    where = " AND ".join(f"isfinite({raw(p)})" for p in reads.split())
    return f"s AS (SELECT DISTINCT {', '.join([*_PLAIN, *cols])} FROM splats{' WHERE ' + where if where else ''})"


def captures(spark, d) -> DataFrame:
    c = read(spark, d, "captures").where((F.col("time_numerator") > 0) & (F.col("time_denominator") > 0))
    return c.select("capture_id", "title", "time_numerator", "time_denominator", "playback_mode", "moving_speed", "tags").dropDuplicates(["capture_id"])


CAPTURES = """cap AS (SELECT DISTINCT capture_id, title, time_numerator, time_denominator, playback_mode, moving_speed, tags FROM captures WHERE time_numerator > 0 AND time_denominator > 0)"""


def chunks(spark, d) -> DataFrame:
    return read(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(
        *[F.min(c).alias(c) for c in ("capture_id", "chunk_index", "start_tick", "intervals", "splat_count", "file_offset", "size_bytes", "start_seconds", "end_seconds")]
    )


CHUNKS = """ch AS (SELECT chunk_id, min(capture_id) AS capture_id, min(chunk_index) AS chunk_index, min(start_tick) AS start_tick, min(intervals) AS intervals, min(splat_count) AS splat_count,
min(file_offset) AS file_offset, min(size_bytes) AS size_bytes, min(start_seconds) AS start_seconds, min(end_seconds) AS end_seconds FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"""


def intervals(spark, d) -> DataFrame:
    return read(spark, d, "chunk_samples").groupBy("chunk_id", "interval_no").agg(*[F.min(c).alias(c) for c in ("tick", "stored_size", "generation", "take_label")])


INTERVALS = """iv AS (SELECT chunk_id, interval_no, min(tick) AS tick, min(stored_size) AS stored_size, min(generation) AS generation, min(take_label) AS take_label FROM chunk_samples GROUP BY chunk_id, interval_no)"""


def trajectories(spark, d) -> DataFrame:
    """(vec_id, capture_id, chunk_id, record_id, p): whole vectors of 24 numbers."""
    p = F.col("positions")
    return read(spark, d, "trajectories").where((F.size(p) == 24) & F.forall(p, lambda v: finite(v))).select("vec_id", "capture_id", "chunk_id", "record_id", p.alias("p")).dropDuplicates(["vec_id"])


TRAJECTORIES = "tr AS (SELECT DISTINCT vec_id, capture_id, chunk_id, record_id, positions AS p FROM trajectories WHERE len(positions) = 24 AND len(list_filter(positions, lambda v: isfinite(v))) = 24)"


def query(*views: str) -> str:
    """The WITH clause of the views."""
    return "WITH " + ",\n".join(views) + "\n"
