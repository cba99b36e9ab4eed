"""Ordered operators whose groups are cut into blocks, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["carry_forward", "carry_all"]


def carry_forward(df: DataFrame, groups: list[str], order: str, value: Column, name: str, block: int = 4096) -> DataFrame:
    """``df`` with column ``name``: the last non-null ``value`` at a smaller integer ``order`` in the same group, else null.

    The window runs within blocks of the ordering; what earlier blocks hand on comes from one row per block. ``order`` should
    be unique in its group; rows of equal order see each other's values or not in no defined manner."""
    return carry_all(df, groups, order, {name: value}, block)


def carry_all(df: DataFrame, groups: list[str], order: str, values: dict[str, Column], block: int = 4096) -> DataFrame:
    """``carry_forward`` of several values (name: value) at once."""
    names = list(values)
    at = range(len(names))
    d = df.withColumn("_b", F.floor(F.col(order) / block).cast("bigint")).withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    inside = Window.partitionBy(*groups, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_in{i}": F.last(f"_v{i}", ignorenulls=True).over(inside) for i in at})
    per = d.groupBy(*groups, "_b").agg(*[F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(order))).alias(f"_last{i}") for i in at])
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_pb"), *[F.last(f"_last{i}", ignorenulls=True).over(before).alias(f"_carry{i}") for i in at])
    per = per.where(" or ".join(f"_carry{i} is not null" for i in at))
    on = F.col("_b") == F.col("_pb")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(per, on, "left").select(*df.columns, *[F.coalesce(f"_in{i}", f"_carry{i}").alias(n) for i, n in enumerate(names)])
