"""Runs, spans and fills along an ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carry_forward

__all__ = ["runs", "spans", "id_runs", "hold_edges", "deltas", "prefix_offsets", "first_island", "carried_error_steps"]


def runs(df: DataFrame, groups: list[str], order: str, value: Column) -> DataFrame:
    """(groups, run, value, first, last, n): runs of an equal value along the ordering; nulls equal each other."""
    w = Window.partitionBy(*groups).orderBy(order)
    d = df.select(*groups, F.col(order).alias("_o"), value.alias("value"))
    w = Window.partitionBy(*groups).orderBy("_o")
    fresh = F.when(F.row_number().over(w) == 1, 1).when(~F.col("value").eqNullSafe(F.lag("value").over(w)), 1).otherwise(0)
    d = d.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w))
    return d.groupBy(*groups, "run").agg(F.first("value").alias("value"), F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("n"))


def spans(df: DataFrame, groups: list[str], order: str, keep: Column) -> DataFrame:
    """(groups, first, end): contiguous stretches, half open, of the integers of ``order`` at which ``keep`` holds."""
    d = df.where(keep).select(*groups, F.col(order).cast("bigint").alias("_o")).distinct()
    w = Window.partitionBy(*groups).orderBy("_o")
    d = d.withColumn("_i", F.col("_o") - F.row_number().over(w))
    return d.groupBy(*groups, "_i").agg(F.min("_o").alias("first"), (F.max("_o") + 1).alias("end")).drop("_i")


def id_runs(df: DataFrame, groups: list[str], ident: str) -> DataFrame:
    """(groups, start, length): ids packed as runs of consecutive numbers."""
    s = spans(df, groups, ident, F.lit(True))
    return s.select(*groups, F.col("first").alias("start"), (F.col("end") - F.col("first")).alias("length"))


def hold_edges(df: DataFrame, groups: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the value, else the last one before, else the first one after."""
    d = carry_forward(df, groups, order, F.col(value), "_before")
    first = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.min_by(value, order).alias("_first"))
    d = d.join(first, groups, "left")
    return d.withColumn(name, F.coalesce(value, "_before", "_first")).drop("_before", "_first")


def deltas(df: DataFrame, groups: list[str], order: str, value: str, step: int = 1) -> DataFrame:
    """``df`` with delta: the difference to the value ``step`` rows before, the value itself for the first rows."""
    w = Window.partitionBy(*groups).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value, step).over(w), F.lit(0)))


def prefix_offsets(df: DataFrame, groups: list[str], order: str, length: str) -> DataFrame:
    """``df`` with offset: where each row's ragged list begins when the group's lists lie end to end."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def first_island(df: DataFrame, groups: list[str], number: str) -> DataFrame:
    """(groups, first, last, n): the numbers from the least on, up to the first gap."""
    s = spans(df, groups, number, F.lit(True))
    one = s.groupBy(*groups).agg(F.min_by(F.struct("first", "end"), "first").alias("s"))
    return one.select(*groups, F.col("s.first").alias("first"), (F.col("s.end") - 1).alias("last"), (F.col("s.end") - F.col("s.first")).alias("n"))


def carried_error_steps(df: DataFrame, groups: list[str], order: str, value: str, step: float) -> DataFrame:
    """(groups, order, code): steps of a closed-loop quantiser, each of which codes what the ones before left. What they left is at
    most half a step, so that code i is round(v_i / step) - round(v_(i-1) / step): no state needs to be carried along."""
    w = Window.partitionBy(*groups).orderBy(order)
    level = F.floor(F.col(value) / step + 0.5)
    d = df.select(*groups, order, level.alias("_l"))
    return d.select(*groups, order, (F.col("_l") - F.coalesce(F.lag("_l").over(w), F.lit(0))).cast("bigint").alias("code"))
