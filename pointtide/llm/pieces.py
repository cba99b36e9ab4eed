"""Splitting oversized items at natural boundaries (problem 2).

A piece that is due at interval c starts up to ``overlap`` intervals earlier and may end before any later interval e within
the limit. Dynamic programming over the positions, from the last to the first, gives each c its best e: the one of the least
own(c, e) + what cost(e) adds. All costs are whole numbers, so that nothing depends on how an item is cut up.

``later`` = 0 (p2_found) compares the costs of an item's pieces in their order: own() puts a natural boundary before any other, and
then the farther end, and weighs more than whatever follows. That is the stated rule. ``later`` = 1 (p2_balanced) adds up the
pieces' costs: own() is the square of the room left unused, and CUT whole rooms more for a cut away from a natural boundary.

Items longer than SEGMENT intervals are cut into segments, each with a view of the segment behind it. A segment hands the costs of
its first positions, less their least, to the one before it, and is computed again when those that it was handed change, until
none do: every segment then follows from the one behind it, as in one pass, and the least total holds for items of any length.
One row per change of the map from entries to exits is followed over the segments, and each segment writes its pieces. A segment
whose view does not reach as far as a piece is computed again with longer segments.

Defined results: repeated rows (same item and interval) count once; null sizes count 0; a missing label goes on with the one
before; items within the limit give no rows; an interval over the limit is a piece of its own; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import carry_all
from ..util import cut, small_enough

__all__ = ["split_oversized", "best_ends"]

SEGMENT = 4096
#: Cost of a cut away from a natural boundary, in squares of a whole piece's room.
CUT = 4
#: Rooms are counted in units of which a piece has at most so many.
UNITS = 1 << 22
#: Digits of a cost in which the later pieces of the ordered comparison stand.
ORDER_BITS = 32


def _starts(prefix: np.ndarray, limit: float, overlap: int) -> np.ndarray:
    """For each c the first interval of the piece that is due there."""
    c = np.arange(len(prefix) - 1)
    s = np.maximum(c - overlap, 0)
    for _ in range(overlap):
        s = np.where((prefix[c + 1] - prefix[s] > limit) & (s < c), s + 1, s)
    return s


def _reach(prefix: np.ndarray, limit: float, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(first interval, last possible end) of the piece that is due at each position."""
    n = len(prefix) - 1
    start = _starts(prefix, limit, overlap)
    far = np.maximum(np.searchsorted(prefix, prefix[start] + limit, side="right") - 1, np.arange(n) + 1)
    return start, np.minimum(far, n)


def _recur(size: np.ndarray, natural: np.ndarray, limit: float, overlap: int, later: float, lo: int, hi: int, cost: np.ndarray, closed: bool):
    """(start, far, end, cost) after the recurrence over the positions hi - 1 to lo; ``cost`` holds those from hi on."""
    prefix = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    start, far = _reach(prefix, limit, overlap)
    nat = np.append(natural, closed).astype(bool)  # the end of the item is a natural place to end
    end, shift = far.copy(), 0 if later else ORDER_BITS
    unit = max(1, -(-int(limit) // UNITS))
    whole = int(limit) // unit
    away = np.where(nat, 0, CUT * whole * whole if later else 1)
    # what each later position adds, and the numbers that fall to 0 at a piece's end
    carry, down, reach, first = cost >> shift, np.arange(len(cost) - 1, -1, -1), far.tolist(), start.tolist()
    for i in range(hi - 1, lo - 1, -1):
        e, n = slice(i + 1, reach[i] + 1), reach[i] - i
        if later:
            room = whole - np.minimum((prefix[e] - prefix[first[i]]) // unit, whole)
            total = away[e] + room * room + carry[e]
            k = n - 1 - int(total[::-1].argmin())
        else:
            total = (away[e] * n + down[len(down) - n:]) << shift
            total += carry[e]
            k = int(total.argmin())
        end[i], cost[i] = i + 1 + k, total[k]
        carry[i] = cost[i] >> shift
        if later and cost[i] > 1 << 61:  # only the positions up to reach[i] are asked for from here on
            cost[i:reach[i] + 1] -= cost[i:reach[i] + 1].min()
            carry[i:reach[i] + 1] = cost[i:reach[i] + 1]
    return start, far, end, cost


def best_ends(size: np.ndarray, natural: np.ndarray, limit: float, overlap: int, later: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, cost) of a piece due at each interval of a whole item; end is exclusive. ``natural[i]``: a boundary lies before i."""
    n = len(size)
    start, _, end, cost = _recur(size, natural, limit, overlap, later, 0, n, np.zeros(n + 1, np.int64), True)
    return start, end, cost[:-1]


def _follow(start, end, at: int, stop: int) -> tuple[list[int], list[int], int]:
    """Pieces (first, exclusive last) that are due from ``at`` on, before ``stop``; where the next is due."""
    a, b = [], []
    while at < stop:
        a.append(int(start[at]))
        b.append(int(end[at]))
        at = int(end[at])
    return a, b, at


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values("i", ignore_index=True)
    return pdf, pdf["size"].to_numpy(np.float64), pdf.natural.to_numpy(bool)


def split_oversized(samples: DataFrame, item: str, order: str, tick: str, size: str, marks: tuple[str, str], limit: int, overlap: int, later: float = 0.0, segment: int = SEGMENT) -> DataFrame:
    """(item, piece_start_tick, piece_intervals): the pieces of every item whose ``size`` adds up to more than ``limit``. ``marks``
    names the two columns (a generation, and a label that may be missing) whose change is a natural boundary."""
    rows = (
        samples.where(F.col(item).isNotNull() & F.col(order).isNotNull())
        .groupBy(F.col(item).alias("item"), F.col(order).cast("bigint").alias("no"))
        .agg(F.min(tick).cast("bigint").alias("tick"), F.coalesce(F.min(size), F.lit(0)).cast("bigint").alias("size"), F.min(marks[0]).alias("gen"), F.min(marks[1]).alias("label"))
    ).persist()
    large = rows.groupBy("item").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("total") > limit).select("item", "n").persist()
    few = small_enough(large, 100_000)
    rows = rows.join(F.broadcast(large) if few else large, "item")
    rows = carry_all(rows, ["item"], "no", {"gen_before": F.col("gen"), "label_before": F.col("label")})
    natural = F.coalesce(F.col("gen") != F.col("gen_before"), F.lit(False)) | ~F.coalesce("label", "label_before").eqNullSafe(F.col("label_before"))
    rows = rows.select("item", F.col("no").alias("i"), "tick", "size", natural.alias("natural"), "n").persist()
    out = "item bigint, piece_start_tick bigint, piece_intervals bigint"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for it, g in pdf.groupby("item", sort=False):
            g, sz, nat = _arrays(g)
            start, end, _ = best_ends(sz, nat, limit, overlap, later)
            a, b, _ = _follow(start, end, 0, len(g))
            parts.append(pd.DataFrame({"item": it, "piece_start_tick": g.tick.to_numpy()[a], "piece_intervals": np.subtract(b, a)}))
        return pd.concat(parts) if parts else pd.DataFrame({"item": [], "piece_start_tick": [], "piece_intervals": []})

    short = rows.where(F.col("n") <= segment)
    # hashing items to tasks keeps some hundreds of them in one call; what they hold together is bounded by the segment
    bin_rows = 64 * segment
    bins = F.pmod(F.xxhash64("item"), F.greatest(F.lit(16), F.lit(int(max(16, _rows(large) // bin_rows + 1))))).alias("bin")
    result = short.groupBy(bins).applyInPandas(whole, out)
    if not small_enough(large.where(F.col("n") > segment), 0):
        result = result.union(_long(rows.where(F.col("n") > segment), limit, overlap, later, segment))
    return result.select(F.col("item").alias(item), "piece_start_tick", "piece_intervals")


def _rows(large: DataFrame) -> int:
    return large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _long(rows: DataFrame, limit: int, overlap: int, later: float, segment: int) -> DataFrame:
    """Items of more than one segment."""
    # intervals are numbered by position, so that gaps in their numbers do no harm
    block = F.floor(F.col("i") / segment).cast("bigint")
    counts = rows.groupBy("item", block.alias("blk")).count()
    upto = counts.withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("item").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("item", "blk").orderBy("i")) - 1
    rows = cut(rows.withColumn("blk", block).withColumn("r", rank).join(upto, ["item", "blk"]).withColumn("i", F.col("base") + F.col("r")).drop("blk", "r", "base"))
    done: DataFrame | None = None
    while True:
        made, unsure = _pass(rows, limit, overlap, later, segment)
        done = made if done is None else done.union(made)
        if small_enough(unsure, 0):
            return done
        rows = cut(rows.join(unsure, "item", "left_semi"))
        segment *= 8


def _pass(rows: DataFrame, limit: int, overlap: int, later: float, segment: int) -> tuple[DataFrame, DataFrame]:
    """Pieces by segments of one length, and the items for which it was too short."""
    seg = F.floor(F.col("i") / segment).cast("bigint")
    seen = F.array_distinct(F.array(seg, F.greatest(seg - 1, F.lit(0)), F.floor((F.col("i") + overlap + 1) / segment).cast("bigint")))
    spread = rows.withColumn("seg", F.explode(seen)).where(F.col("seg") * segment < F.col("n")).persist()

    def table(pdf: pd.DataFrame, handed: pd.DataFrame):
        g, sz, nat = _arrays(pdf)
        first, sg, n = int(g.i.iloc[0]), int(g.seg.iloc[0]), int(g.n.iloc[0])
        lo, hi = sg * segment - first, min((sg + 1) * segment, n) - first
        cost = np.zeros(len(g) + 1, np.int64)
        if len(handed):
            cost[hi:hi + len(handed.vec.iloc[0])] = handed.vec.iloc[0]
        start, far, end, cost = _recur(sz, nat, limit, overlap, later, lo, hi, cost, first + len(g) >= n)
        return g, first, sg, lo, hi, n, start, far, end, cost

    def hand_on(pdf: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        """The costs of the positions to which a piece that is due before this segment may lead."""
        if not len(pdf):
            return pd.DataFrame({"item": [], "seg": [], "vec": np.empty(0, object)})
        g, first, sg, lo, hi, n, _, far, _, cost = table(pdf, handed)
        if not sg:
            return pd.DataFrame({"item": [], "seg": [], "vec": np.empty(0, object)})
        vec = cost[lo:min(far[lo - 1] + 1, hi + (first + hi == n))]
        return pd.DataFrame({"item": g.item.iloc[0], "seg": sg - 1, "vec": [vec - vec.min()]})

    def exits(pdf: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"item": [], "seg": [], "n": [], "since": [], "leave": [], "sure": []})
        g, first, sg, lo, hi, n, _, far, end, _ = table(pdf, handed)
        leave = end.copy()
        for c in range(hi - 1, lo - 1, -1):
            if leave[c] < hi:
                leave[c] = leave[leave[c]]
        own = leave[lo:min(far[lo - 1] + 1, hi)] if sg else leave[lo:lo + 1]
        change = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sure = bool(first + len(g) >= n or far[hi - 1] < len(g))
        return pd.DataFrame({"item": g.item.iloc[0], "seg": sg, "n": n, "since": first + lo + change, "leave": first + own[change], "sure": sure})

    vec = "item bigint, seg bigint, vec array<bigint>"
    none = rows.sparkSession.createDataFrame([], vec)
    beside = lambda a, b, f, schema: a.groupBy("item", "seg").cogroup(b.groupBy("item", "seg")).applyInPandas(f, schema)
    vecs = none
    if later:  # without, what a piece costs by itself decides, whatever it is handed
        vecs = changed = cut(beside(spread, none, hand_on, vec))
        while not small_enough(changed, 0):
            made = beside(spread.join(changed.select("item", "seg"), ["item", "seg"], "left_semi"), changed, hand_on, vec)
            changed = cut(made.join(vecs.withColumnRenamed("vec", "was"), ["item", "seg"]).where("vec != was").drop("was"))
            vecs = cut(vecs.join(changed, ["item", "seg"], "left_anti").union(changed))
    maps = cut(beside(spread, vecs, exits, "item bigint, seg bigint, n bigint, since bigint, leave bigint, sure boolean"))
    unsure = maps.where("not sure").select("item").distinct()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("since")
        since, leave, n = pdf.since.to_numpy(), pdf.leave.to_numpy(), int(pdf.n.iloc[0])
        at, out = 0, []
        while at < n:
            out.append((at // segment, at))
            at = int(leave[np.searchsorted(since, at, side="right") - 1])
        return pd.DataFrame({"item": pdf.item.iloc[0], "seg": [o[0] for o in out], "entry": [o[1] for o in out]})

    # the entries of a segment are few: those that one piece from before it may lead to
    entries = maps.join(unsure, "item", "left_anti").groupBy("item").applyInPandas(walk, "item bigint, seg bigint, entry bigint")

    def write(pdf: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"item": [], "piece_start_tick": [], "piece_intervals": []})
        g, first, _, _, hi, _, start, _, end, _ = table(pdf, handed)
        a, b, _ = _follow(start, end, int(g.entry.iloc[0]) - first, hi)
        return pd.DataFrame({"item": g.item.iloc[0], "piece_start_tick": g.tick.to_numpy()[a], "piece_intervals": np.subtract(b, a)})

    return beside(spread.join(entries, ["item", "seg"]), vecs, write, "item bigint, piece_start_tick bigint, piece_intervals bigint"), unsure
