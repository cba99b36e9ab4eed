"""Schemas that drift between the files of a sequence (problem 3).

The header of each frame is compared with that of the frame before. Where names go and others come in one frame, their columns are
profiled: one pass over the vertices gives each a sketch (count, mean, spread, least and largest value), and pairs whose
sketches are too far apart for the values to carry on are ruled out. The others are compared vertex by vertex: the mean step
from the old to the new column in units of the old one's spread. A minimum-cost bipartite matching per frame over steps, with the
likeness of names and types to settle ties, picks the renames. Chains of renames form one property, whose types are followed
over time; its values go to one column of the unified table.

Defined results: repeated rows count once; a frame written under several file ids is one frame, whose types are those that
any of them states and whose values are those of the smallest file id; null names are ignored, null types say nothing; lines
that do not parse, or vertices without a partner, give no evidence, and without evidence there is no rename; a name that
comes back after a gap is added afresh, with no type carried over; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import cut, small_enough
from .graph import connected_components
from .ordered import carry_forward

__all__ = ["TYPE_SPELLINGS", "canonical_type", "best_matching", "Drift"]

#: The spellings of the scalar types of a PLY header.
TYPE_SPELLINGS = {
    "char": "int8", "uchar": "uint8", "short": "int16", "ushort": "uint16", "int": "int32", "uint": "uint32",
    "float": "float32", "double": "float64",
}
#: Mean step, in standard deviations of the old column, up to which the values carry on.
CARRIES_ON = 0.15
#: Distance of the means, in standard deviations of the old column, and factor between the spreads, up to which sketches leave a pair
#: to be compared. Where the values carry on over all vertices, the means differ by no more than the mean step, which is CARRIES_ON.
SKETCH_MEAN, SKETCH_SPREAD = 0.75, 3.0
BROADCAST_ROWS = 50_000
#: Rows of scored pairs that share one matching task.
MATCH_ROWS = 20_000


def canonical_type(c):
    """One spelling for each type; unknown ones are kept as they are, blank ones are null."""
    t = F.lower(F.trim(c))
    out = F.when(t == "", None).otherwise(t)
    for a, b in TYPE_SPELLINGS.items():
        out = F.when(t == a, b).otherwise(out)
    return out


def _words(line: str):
    """The words of a line, whatever white space parts them."""
    return F.split(F.btrim(F.col(line), F.lit(" \t\n\r\f\v")), r"\s+")


def best_matching(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost that match every row or every column, by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=np.int64)  # row held by each column, from 1; 0: free
    for row in range(1, n + 1):
        owner[0] = row
        at, least, came = 0, np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        seen = np.zeros(m + 1, dtype=bool)
        while owner[at]:
            seen[at] = True
            step = c[owner[at] - 1] - u[owner[at]] - v[1:]
            free = ~seen[1:]
            better = free & (step < least[1:])
            least[1:][better] = step[better]
            came[1:][better] = at
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            gain = least[nxt]
            u[owner[seen]] += gain
            v[seen] -= gain
            least[1:][free] -= gain
            at = nxt
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _hint(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (seq, frame), g in pdf.groupby(["sequence_id", "frame_no"], sort=False):
        old, new = sorted(set(g.old)), sorted(set(g.new))
        cost = np.full((len(old), len(new)), 10.0)
        steps = np.full((len(old), len(new)), np.inf)
        at = [old.index(o) for o in g.old], [new.index(n) for n in g.new]
        steps[at] = g.step
        cost[at] = np.where(g.step <= CARRIES_ON, g.step + 0.01 * g.unlike.clip(0, 1) + 0.01 * g.retype, 10.0)
        out += [(seq, frame, old[i], new[j]) for i, j in best_matching(cost) if steps[i, j] <= CARRIES_ON]
    return pd.DataFrame(out, columns=["sequence_id", "frame_no", "old", "new"])


class Drift:
    """Changes and the unified table of ``files`` (file_id, sequence_id, frame_no), ``properties`` (file_id, ordinal, prop_name,
    prop_type) and ``vertices`` (file_id, row_no, line)."""

    def __init__(self, files: DataFrame, properties: DataFrame, vertices: DataFrame):
        self.files = files.where("file_id is not null and sequence_id is not null and frame_no is not null").groupBy("file_id").agg(F.min("sequence_id").alias("sequence_id"), F.min("frame_no").alias("frame_no"))
        self.properties = (
            properties.where("file_id is not null and prop_name is not null and ordinal is not null")
            .groupBy("file_id", "prop_name").agg(F.min("ordinal").alias("ordinal"), F.max(canonical_type(F.col("prop_type"))).alias("type"))
        )
        self.vertices = vertices.where("file_id is not null and row_no is not null and line is not null").select("file_id", "row_no", "line")
        self.header = cut(
            self.properties.join(self.files, "file_id").groupBy("sequence_id", "frame_no", F.col("prop_name").alias("name"))
            .agg(F.max("type").alias("type"), F.min_by(F.struct("file_id", "ordinal"), "file_id").alias("at"))
        )
        self._changes()

    def _changes(self) -> None:
        frames = self.files.groupBy("sequence_id", "frame_no").agg(F.min("file_id").alias("file_id"))
        frames = cut(carry_forward(frames, ["sequence_id"], "frame_no", F.struct("frame_no", "file_id"), "was"))
        now = self.header.select("sequence_id", "frame_no", "name", "type", "at")
        follows = frames.where("was is not null").select("sequence_id", F.col("frame_no").alias("next"), F.col("was.frame_no").alias("frame_no"))
        then = now.join(follows, ["sequence_id", "frame_no"]).select("sequence_id", F.col("next").alias("frame_no"), "name", F.col("type").alias("old_type"), F.col("at").alias("old_at"))
        first = frames.where("was is null").select("sequence_id", "frame_no", F.lit(True).alias("first"))
        both = cut(now.withColumn("here", F.lit(True)).join(then.withColumn("there", F.lit(True)), ["sequence_id", "frame_no", "name"], "full_outer").where("here is null or there is null"))
        came = both.where("here and there is null").drop("there", "here", "old_type", "old_at")
        came = came.join(first, ["sequence_id", "frame_no"], "left")
        self.starts = came.select("sequence_id", "frame_no", "name")
        came = came.where("first is null").drop("first")
        gone = both.where("there and here is null").select("sequence_id", "frame_no", "name", F.col("old_type").alias("type"), F.col("old_at").alias("at"))
        self.came, self.gone = came, gone
        self.renames = cut(self._renames())
        keys = ["sequence_id", "frame_no"]
        renamed = self.renames.select(*keys, F.lit("renamed").alias("change_kind"), F.col("new").alias("prop_name"))
        added = came.join(self.renames.select(*keys, F.col("new").alias("name")), [*keys, "name"], "left_anti").select(*keys, F.lit("added"), "name")
        removed = gone.join(self.renames.select(*keys, F.col("old").alias("name")), [*keys, "name"], "left_anti").select(*keys, F.lit("removed"), "name")
        # a line is one property through all its names: spans of presence, tied together by renames
        span = F.xxhash64("sequence_id", "name", "since")
        spans = self.starts.withColumn("since", F.col("frame_no"))
        rows = self.header.join(spans.select("sequence_id", "frame_no", "name", "since"), ["sequence_id", "frame_no", "name"], "left")
        rows = carry_forward(rows, ["sequence_id", "name"], "frame_no", F.col("since"), "earlier").withColumn("since", F.coalesce("since", "earlier")).drop("earlier")
        rows = cut(rows.withColumn("span", span))
        ends = rows.select("sequence_id", F.col("frame_no").alias("was_frame"), F.col("name").alias("old"), F.col("span").alias("dst"))
        prior = frames.where("was is not null").select("sequence_id", "frame_no", F.col("was.frame_no").alias("was_frame"))
        ties = self.renames.join(prior, keys).join(ends, ["sequence_id", "was_frame", "old"]).select(F.xxhash64("sequence_id", "new", "frame_no").alias("src"), "dst")
        lines = connected_components(ties).select(F.col("node").alias("span"), "component")
        self.lines = rows.join(lines, "span", "left").withColumn("line", F.coalesce("component", "span")).drop("component")
        typed = carry_forward(self.lines, ["line"], "frame_no", F.col("type"), "known")
        retyped = typed.where("type != known").select(*keys, F.lit("retyped"), "name")
        self.changes = renamed.union(added).union(removed).union(retyped)

    def _renames(self) -> DataFrame:
        keys = ["sequence_id", "frame_no"]
        pair = cut(self.gone.select(*keys, F.col("name").alias("old"), F.col("type").alias("old_type"), F.col("at").alias("old_at")).join(
            self.came.select(*keys, F.col("name").alias("new"), F.col("type").alias("new_type"), F.col("at").alias("new_at")), keys
        ))
        ask = (
            pair.select(*keys, F.col("old_at.file_id").alias("file_id"), F.col("old_at.ordinal").alias("ordinal"), F.col("old").alias("name"), F.lit(True).alias("past"))
            .union(pair.select(*keys, "new_at.file_id", "new_at.ordinal", "new", F.lit(False))).distinct()
        )
        # a line is taken apart once for all columns that are asked of its file
        ask = ask.groupBy("file_id").agg(F.collect_list(F.struct(*keys, "name", "past", "ordinal")).alias("asked"))
        few = small_enough(ask, BROADCAST_ROWS)
        values = (
            self.vertices.join(F.broadcast(ask) if few else ask, "file_id")
            .select("row_no", "asked", _words("line").alias("cell"))
            .select("row_no", F.explode(F.transform("asked", lambda q: F.struct(q[keys[0]].alias(keys[0]), q[keys[1]].alias(keys[1]), q["name"].alias("name"), q["past"].alias("past"), F.get("cell", q["ordinal"]).try_cast("double").alias("v")))).alias("q"))
            .select("row_no", "q.*").where(F.col("v").isNotNull() & ~F.isnan("v")).persist()
        )
        survivors = cut(self._alike_sketches(pair, values))
        few = small_enough(survivors, BROADCAST_ROWS)
        side = lambda past, name, v: values.where("past" if past else "not past").join(_hint(survivors.select(*keys, F.col(name).alias("name")).distinct(), few), [*keys, "name"], "left_semi").groupBy(*keys, F.col("name").alias(name), "row_no").agg(F.min("v").alias(v))
        tiny = F.lit(1e-9)
        compared = (
            side(True, "old", "a").join(side(False, "new", "b"), [*keys, "row_no"]).join(_hint(survivors.select(*keys, "old", "new"), few), [*keys, "old", "new"], "left_semi")
            .groupBy(*keys, "old", "new")
            .agg((F.avg(F.abs(F.col("a") - F.col("b"))) / F.greatest(F.stddev_pop("a"), F.avg(F.abs("a")) * tiny, tiny)).alias("step"))
            .where(F.col("step") <= CARRIES_ON)
        )
        unlike = F.levenshtein(F.lower("old"), F.lower("new")) / F.greatest(F.length("old"), F.length("new"), F.lit(1))
        scored = compared.join(pair, [*keys, "old", "new"]).select(*keys, "old", "new", "step", unlike.alias("unlike"), F.when(F.col("old_type") != F.col("new_type"), 1.0).otherwise(0.0).alias("retype"))
        kinds = dict(self.files.dtypes)
        scored = cut(scored)
        parts = scored.count() // MATCH_ROWS + 8
        return scored.groupBy(F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part")).applyInPandas(
            lambda p: _match(p), f"sequence_id {kinds['sequence_id']}, frame_no {kinds['frame_no']}, old string, new string"
        )

    def _alike_sketches(self, pair: DataFrame, values: DataFrame) -> DataFrame:
        """The pairs whose columns' sketches leave it open that the values carry on."""
        keys = ["sequence_id", "frame_no"]
        sketch = cut(values.groupBy(*keys, "name", "past").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high")))
        one = lambda past, name, p: sketch.where("past" if past else "not past").select(*keys, F.col("name").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "mean", "sd", "low", "high")])
        both = pair.join(one(True, "old", "a"), [*keys, "old"]).join(one(False, "new", "b"), [*keys, "new"])
        # a few outlying values move means and spreads, but not where the bulk of both columns lies apart
        unit = F.greatest("a_sd", F.abs("a_mean") * 1e-6, F.lit(1e-9))
        level = F.abs(F.col("a_mean") - F.col("b_mean")) <= unit * SKETCH_MEAN
        spread = (F.col("b_sd") <= unit * SKETCH_SPREAD) & (F.col("b_sd") * SKETCH_SPREAD >= F.col("a_sd"))
        meet = (F.col("a_low") <= F.col("b_high") + unit) & (F.col("b_low") <= F.col("a_high") + unit)
        # means over different vertices may differ by more; such pairs are always compared
        same = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * 0.9
        return both.where(~same | (level & spread & meet)).select(*pair.columns)

    def _rows(self) -> tuple[DataFrame, DataFrame]:
        """(the vertices of every frame once, with their words and the ordinals of their properties; the properties of all lines)."""
        named = self.lines.groupBy("line").agg(F.min_by("name", "frame_no").alias("property"), F.coalesce(F.bool_and(F.col("type").rlike("^u?int(8|16|32)$")), F.lit(False)).alias("whole"))
        frames = self.files.groupBy("sequence_id", "frame_no").agg(F.min("file_id").alias("file_id"))
        lines = self.lines.join(named, "line").select("sequence_id", "frame_no", "name", "property")
        place = self.properties.join(frames, "file_id").select("file_id", "sequence_id", "frame_no", F.col("prop_name").alias("name"), "ordinal").join(lines, ["sequence_id", "frame_no", "name"])
        # of two properties of one file with the same first name, the one at the smaller ordinal counts
        place = place.groupBy("file_id", "sequence_id", "frame_no", "property").agg(F.min("ordinal").alias("ordinal"))
        layout = place.groupBy("file_id", "sequence_id", "frame_no").agg(F.map_from_entries(F.collect_list(F.struct("property", "ordinal"))).alias("layout"))
        rows = self.vertices.join(layout, "file_id").withColumn("cell", _words("line"))
        rows = rows.groupBy("sequence_id", "frame_no", "row_no").agg(F.min_by(F.struct("cell", "layout"), "file_id").alias("r"))
        return rows, named

    def cells(self) -> DataFrame:
        """(sequence_id, frame_no, row_no, property, value): the unified table by cells, as doubles; a value that doesn't parse is null."""
        rows, named = self._rows()
        cell = F.explode("r.layout").alias("property", "ordinal")
        return rows.select("sequence_id", "frame_no", "row_no", "r.cell", cell).select("sequence_id", "frame_no", "row_no", "property", F.get("cell", F.col("ordinal")).try_cast("double").alias("value"))

    def unified(self) -> DataFrame:
        """(sequence_id, frame_no, row_no, one column per property): every vertex of every frame once. A property is named as its
        line was first named; whole numbers throughout give bigint, else double. A name that differs from an earlier column's
        only in case, or equals a key's, gets a number behind it. The list of columns goes to the driver; its length is that of
        the schema."""
        rows, named = self._rows()
        cols = named.groupBy("property").agg(F.bool_and("whole").alias("whole")).orderBy("property").collect()
        used, out = {"sequence_id", "frame_no", "row_no"}, []
        for c in cols:
            name, n = c["property"], 2
            while name.lower() in used:
                name, n = f"{c['property']}_{n}", n + 1
            used.add(name.lower())
            v = F.get(F.col("r.cell"), F.col("r.layout")[c["property"]]).try_cast("double")
            out.append((v.cast("bigint") if c["whole"] else v).alias(name))
        return rows.select("sequence_id", "frame_no", "row_no", *out)
