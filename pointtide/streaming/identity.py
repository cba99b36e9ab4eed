"""Streams: identities of records across frames with carried state, windows with watermarks, arrival in steps."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..util import ensure_checkpoint_dir

__all__ = ["track_identities", "run_to_table", "windowed_counts", "SEGMENT_SCHEMA"]

SEGMENT_SCHEMA = "key bigint, generation bigint, first bigint, last bigint, mark string, n bigint"
_STATE = "generation bigint, first bigint, last bigint, mark string, n bigint"


def track_identities(stream: DataFrame, gap: int) -> DataFrame:
    """Segments of ``stream`` (key, at bigint, mark): a new generation, from 1 on, begins where the mark changes or more than ``gap`` passes
    between two events of a key. Every segment that a batch touches is reported as it then stands (update mode).

    An event from before the end of its key's state comes too late to count, since generations only ever grow: it is reported by
    itself, as generation 0, and the stream goes on."""

    def step(key, batches, state):
        generation, first, last, mark, n = state.get if state.exists else (0, 0, 0, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "mark"], kind="stable")
        late = rows["at"] < last if n else rows["at"] != rows["at"]
        out += [(key[0], 0, at, at, m, 1) for at, m in zip(rows["at"][late].tolist(), rows["mark"][late].tolist())]
        rows = rows[~late]
        if len(rows):
            at, marks = rows["at"].to_numpy(), rows["mark"].to_numpy(object)
            before, held = np.append(last, at[:-1]), np.append(np.array([mark], object), marks[:-1])
            fresh = (marks != held) | (at - before > gap)
            fresh[0] |= not n
            start = np.flatnonzero(fresh)
            ends = np.append(start, len(at))
            if ends[0] > 0:  # what the state holds goes on
                last, n = int(at[ends[0] - 1]), n + int(ends[0])
                out.append((key[0], generation, first, last, mark, n))
            for i, j in zip(ends, ends[1:]):
                generation, first, last, mark, n = generation + 1, int(at[i]), int(at[j - 1]), marks[i], int(j - i)
                out.append((key[0], generation, first, last, mark, n))
            state.update((generation, first, last, mark, n))
        yield pd.DataFrame(out, columns=["key", "generation", "first", "last", "mark", "n"])

    return stream.select("key", "at", "mark").groupBy("key").applyInPandasWithState(step, SEGMENT_SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all there is and returns ``merge`` of what its batches reported (with ``batch``, their number). Batches are
    written to the shared folder; a batch that is tried again overwrites itself."""
    home = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return merge(spark.read.parquet(f"{home}/out"))


def windowed_counts(stream: DataFrame, at: str, every: str, late: str, keys: list[str]) -> DataFrame:
    """(start, keys, n): events per window of event time; windows close ``late`` after their end."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "n")
