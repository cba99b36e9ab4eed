"""Records at an instant, activity and bounds over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import ticks_at

__all__ = ["alive_at", "locate_instants", "instants_per_chunk", "activity", "axis_bounds"]


def alive_at(sample: Column, start: str = "life_start", end: str = "life_end") -> Column:
    """Whether a record lives through the interval that begins at a sample: its life is half-open."""
    return (sample >= F.col(start)) & (sample + 1 <= F.col(end))


def locate_instants(chunks: DataFrame, instants: DataFrame) -> DataFrame:
    """``instants`` (capture_id, seconds, time_numerator, time_denominator) with chunk_id, sample_a, sample_b and alpha.

    Times are clamped to the capture; an instant belongs to the first chunk that ends after it, the very end to the last one.
    The chunk is found by an equi join on the capture and a range condition; no pair of chunks of different captures meets."""
    ends = chunks.groupBy("capture_id").agg(F.max(F.col("start_tick") + F.col("intervals")).alias("last"))
    at = instants.join(ends, "capture_id").withColumn("tick", ticks_at(F.greatest(F.col("seconds"), F.lit(0.0)), F.col("time_numerator"), F.col("time_denominator")))
    at = at.withColumn("tick", F.least(F.col("tick"), F.col("last").cast("double")))
    end = F.col("start_tick") + F.col("intervals")
    inside = (F.col("tick") >= F.col("start_tick")) & ((F.col("tick") < end) | ((F.col("tick") == end) & (end == F.col("last"))))
    hit = at.join(chunks.select("capture_id", "chunk_id", "start_tick", "intervals"), "capture_id").where(inside)
    offset = F.least(F.col("tick") - F.col("start_tick"), F.col("intervals").cast("double"))
    return (
        hit.withColumn("offset", offset)
        .withColumn("sample_a", F.floor("offset").cast("bigint"))
        .withColumn("sample_b", F.least(F.floor("offset") + 1, F.col("intervals")).cast("bigint"))
        .withColumn("alpha", F.col("offset") - F.floor("offset"))
        .drop("offset", "last", "start_tick", "intervals")
    )


def instants_per_chunk(chunks: DataFrame, captures: DataFrame, rate: int) -> DataFrame:
    """(capture_id, chunk_id, frames, first_frame, last_sample): how many of the instants k / ``rate`` seconds that fit a capture
    ``locate_instants`` puts into each chunk, the first k, and sample_a of the last one. ``captures`` has capture_id, time_numerator and
    time_denominator.

    Ticks grow with k, so that a chunk's instants are a range of k: its ends are worked out, and no instant becomes a row."""
    ends = chunks.groupBy("capture_id").agg(F.max(F.col("start_tick") + F.col("intervals")).alias("last"))
    num, den = F.col("time_numerator"), F.col("time_denominator")
    c = chunks.select("capture_id", "chunk_id", "start_tick", "intervals").join(captures.select("capture_id", "time_numerator", "time_denominator").join(ends, "capture_id"), "capture_id")
    c = c.withColumn("_most", F.floor(F.col("last") * num / den * rate)).where("_most >= 0").withColumn("_end", F.col("start_tick") + F.col("intervals"))
    tick = lambda k: ticks_at(k / float(rate), num, den)

    def first(bound: Column) -> Column:
        """The first k whose tick is not below ``bound``: about where a tick is taken for it, then exactly."""
        bound = bound.cast("double")
        about = (bound - F.least(F.lit(0.5), F.greatest(F.lit(1.0), F.abs(bound)) * 1e-9)) * (num / den) * rate
        about = F.floor(F.greatest(F.lit(0.0), F.least(F.col("_most") + 1.0, about)))
        near = F.transform(F.sequence(about - 3, about + 3), lambda k: F.greatest(k, F.lit(0)))
        return F.least(F.col("_most") + 1, F.array_min(F.filter(near, lambda k: tick(k) >= bound)))

    rest = F.when(F.col("_end") == F.col("last"), F.col("_most") + 1).otherwise(first(F.col("_end")))
    # a generator, so that the plan works the ends out once
    ends = F.explode(F.array(F.struct(first(F.col("start_tick")).alias("first"), rest.alias("next")))).alias("_at")
    c = c.where(F.col("start_tick") <= F.col("last")).select("*", ends).withColumns({"_first": F.col("_at.first"), "_next": F.col("_at.next")}).where("_next > _first")
    offset = F.least(F.least(tick(F.col("_next") - 1), F.col("last").cast("double")) - F.col("start_tick"), F.col("intervals").cast("double"))
    return c.select("capture_id", "chunk_id", (F.col("_next") - F.col("_first")).alias("frames"), F.col("_first").cast("int").alias("first_frame"), F.floor(offset).cast("bigint").alias("last_sample"))


def activity(records: DataFrame, keys: list[str], start: str = "life_start", end: str = "life_end") -> DataFrame:
    """keys, frame, active: how many records live through each frame. Lives become steps up and down that are summed in order, so
    that a life costs two rows, not one per frame."""
    steps = records.where(F.col(end) > F.col(start)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("frame"), F.lit(1).alias("n")), F.struct(F.col(end).alias("frame"), F.lit(-1).alias("n")))).alias("e"))
    step = steps.groupBy(*keys, F.col("e.frame").alias("frame")).agg(F.sum("e.n").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("frame")
    level = step.withColumn("active", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("frame").over(w))
    return level.where("active > 0").select(*keys, F.explode(F.sequence("frame", F.col("until") - 1)).alias("frame"), F.col("active").cast("bigint").alias("active"))


def axis_bounds(df: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Least and largest of every axis, per level of the keys (grouping sets from the full keys up to the whole)."""
    aggs = [F.count(F.lit(1)).alias("records")]
    for a in axes:
        aggs += [F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max")]
    return df.rollup(*keys).agg(*aggs)
