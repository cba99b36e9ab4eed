"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["read", "ensure_checkpoint_dir", "cut", "finite", "small_enough", "join_null_safe"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one already set, else the session's ``spark.checkpoint.dir``. On one machine, as in tests,
    a temporary folder stands in for it; a cluster without a shared folder is refused."""
    sc = spark.sparkContext
    wanted = sc.getConf().get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        wanted = os.path.join(tempfile.gettempdir(), "pointtide-checkpoints")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """An equi join in which null keys equal each other; the keys appear once."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(F.broadcast(r) if broadcast else r, on, how).drop(*[f"_r_{k}" for k in keys])
