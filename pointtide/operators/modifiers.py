"""The modifier stack: an ordered list of specifications compiled to one DataFrame pipeline.

Whatever the order of the list, pruning and erasing come first, then crops and the green filter, then isolation, then colour.
Order within the list counts where it must: for green filters before or after colour, the product of colour matrices, and
several isolation or prune filters, each of which works on what the one before left.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import colour_matrix, despill, fold_matrices, green_matches
from ..functions.geometry import Transform, apply_affine, apply_linear, in_box, in_cylinder, keyed_transform
from .evaluate import covariance_bake
from .ranking import prune_budget
from .spatial import nth_neighbour_distances, upper_medians
from .surface import rendered_contributions

__all__ = ["Modifier", "Pipeline", "crop_keeps", "antialias_bake", "bake_size", "KINDS", "REMOVING", "load", "dump"]

KINDS = ("crop", "remove-green", "purge-isolated", "prune-low-contribution", "erase", "colour", "animate-transform", "bake-antialiasing", "walk", "audio", "loop-morph")
REMOVING = ("crop", "remove-green", "purge-isolated", "erase", "prune-low-contribution")
_FADING = ("colour",)
_UNTIMED = ("walk", "audio", "loop-morph", "bake-antialiasing")


@dataclass(frozen=True)
class Modifier:
    """kind, whether it is on, its range of frames (-1: open), fades in frames, track, and the parameters of the kind."""

    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    start: int = -1
    end: int = -1
    fade_in: int = 0
    fade_out: int = 0
    track: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown modifier kind {self.kind!r}")

    def covers(self, frame: float) -> bool:
        return self.kind in _UNTIMED or ((self.start < 0 or frame >= self.start - 1e-6) and (self.end < 0 or frame <= self.end + 1e-6))

    def weight(self, frame: float) -> float:
        if not self.covers(frame):
            return 0.0
        if self.kind not in _FADING:
            return 1.0
        w = 1.0
        if self.fade_in > 0:
            w = min(w, (frame - max(0, self.start) + 1) / (self.fade_in + 1))
        if self.fade_out > 0 and self.end >= 0:
            w = min(w, (self.end - frame + 1) / (self.fade_out + 1))
        return max(0.0, min(1.0, w))

    def matrix(self) -> np.ndarray:
        p = self.params
        return colour_matrix(p.get("exposure", 0.0), p.get("temperature", 0.0), p.get("tint", 0.0), p.get("saturation", 1.0))

    def at(self, frame: float) -> "Modifier | None":
        """As it is at a frame: None outside its range; colours part of the way from neutral while they fade; crops between their
        keys."""
        w = self.weight(frame)
        if not self.enabled or w <= 0:
            return None
        p = dict(self.params)
        if self.kind == "colour" and w < 1:
            for name, neutral in (("exposure", 0.0), ("temperature", 0.0), ("tint", 0.0), ("saturation", 1.0), ("opacity", 1.0)):
                p[name] = neutral + (p.get(name, neutral) - neutral) * w
        if self.kind == "crop" and p.get("keys"):
            keys = sorted(p["keys"], key=lambda k: k["frame"])
            if any("rotation" in k for k in keys):
                pose = keyed_transform([(k["frame"], _pose({**p, **k})) for k in keys], frame)
                p |= {"position": pose.position, "rotation": pose.rotation, "scale": pose.scale, "shear": pose.shear}
            for name in ("radius", "height", "width", "depth"):
                seen = [(k["frame"], k[name]) for k in keys if name in k]
                if seen:
                    p[name] = float(np.interp(frame, *zip(*seen)))
            seen = [(k["frame"], k["position"]) for k in keys if "position" in k]
            if seen and not any("rotation" in k for k in keys):
                p["position"] = [float(np.interp(frame, [f for f, _ in seen], [v[i] for _, v in seen])) for i in range(3)]
        return replace(self, params=p)


def _pose(key: dict) -> Transform:
    return Transform(key.get("position", key.get("offset", (0, 0, 0))), key.get("rotation", (0, 0, 0)), key.get("scale", (1, 1, 1)), key.get("shear", (0, 0, 0)))


def bake_size(distance: float = 2.5, height: int = 1080) -> float:
    """World size of the filter that a pixel of a view of 45 degrees from ``distance`` stands for."""
    return float(np.sqrt(0.3) * distance * 2 * np.tan(np.radians(22.5)) / max(1, height))


def antialias_bake(scales: list[Column], opacity: Column, size: float) -> tuple[list[Column], Column]:
    """Scales widened by ``size``, and the opacity lowered by the growth of the two largest axes."""
    grown = [F.sqrt(s * s + size * size) for s in scales]
    ratio = [F.when(g > 0, s / g).otherwise(F.lit(0.0)) for s, g in zip(scales, grown)]
    low = F.least(*ratio)
    two = F.when(low > 0, ratio[0] * ratio[1] * ratio[2] / low).otherwise(F.greatest(ratio[0] * ratio[1], ratio[0] * ratio[2], ratio[1] * ratio[2]))
    return grown, opacity * two


def _inside(p: dict) -> Column:
    inv = Transform(p.get("position", (0, 0, 0)), p.get("rotation", (0, 0, 0)), p.get("scale", (1, 1, 1)), p.get("shear", (0, 0, 0))).inverse()
    x, y, z = apply_affine(inv, F.col("x"), F.col("y"), F.col("z"))
    if p.get("shape", "cylinder") == "box":
        return in_box(x, y, z, p.get("width", 2.0), p.get("height", 2.0), p.get("depth", 2.0))
    return in_cylinder(x, y, z, p.get("radius", 1.0), p.get("height", 2.0), p.get("radius_z"))


def crop_keeps(crops: list[dict]) -> Column:
    """Inside some keeping volume, where there is one, and inside no removing volume."""
    keep, drop = None, None
    for p in crops:
        inside = _inside(p)
        if p.get("remove"):
            drop = inside if drop is None else drop | inside
        else:
            keep = inside if keep is None else keep | inside
    out = F.lit(True) if keep is None else keep
    return out if drop is None else out & ~drop


class Pipeline:
    """A stack of modifiers. Builders return a new pipeline; ``run`` compiles it for a frame and applies it."""

    def __init__(self, modifiers: tuple[Modifier, ...] = ()):
        self.modifiers = tuple(modifiers)

    def add(self, kind: str, params: dict | None = None, **timing) -> "Pipeline":
        return Pipeline((*self.modifiers, Modifier(kind, params or {}, **timing)))

    def move(self, at: int, to: int) -> "Pipeline":
        m = list(self.modifiers)
        m.insert(to, m.pop(at))
        return Pipeline(tuple(m))

    def remove(self, at: int) -> "Pipeline":
        return Pipeline(self.modifiers[:at] + self.modifiers[at + 1:])

    def by_track(self) -> "Pipeline":
        """Modifiers of one track side by side, by their start, tracks in order of first appearance."""
        order = {}
        for i, m in enumerate(self.modifiers):
            order.setdefault(m.track or f"\0{i}", len(order))
        name = [m.track or f"\0{i}" for i, m in enumerate(self.modifiers)]
        by = sorted(range(len(name)), key=lambda i: (order[name[i]], max(0, self.modifiers[i].start), i))
        return Pipeline(tuple(self.modifiers[i] for i in by))

    def split_at_morph(self) -> tuple["Pipeline", "Pipeline"]:
        """The stack above and below the first active loop morph: only what removes records is divided."""
        at = next((i for i, m in enumerate(self.modifiers) if m.enabled and m.kind == "loop-morph"), None)
        if at is None:
            return self, self
        rest = [(i, m) for i, m in enumerate(self.modifiers) if m.kind != "loop-morph"]
        above = tuple(m for i, m in rest if m.kind not in REMOVING or i < at)
        below = tuple(m for i, m in rest if m.kind not in REMOVING or i > at)
        return Pipeline(above), Pipeline(below)

    def walked(self, seconds: float, start: float = 0.0) -> float:
        return sum(m.params.get("speed", 0.0) for m in self.modifiers if m.enabled and m.kind == "walk") * (seconds - start)

    def run(self, df: DataFrame, frame: float, picks: DataFrame | None = None) -> DataFrame:
        """``df`` (chunk_id, record_id, splat_id, x, y, z, sx, sy, sz, o, r, g, b) after the stack; ``picks`` (chunk_id, record_id)
        are the records that erase modifiers name. Pruning ranks by rendered contributions of the records as they come in, which also read
        qx to qw, life_start, life_end and intervals where ``df`` has them."""
        stack = [m for m in (m.at(frame) for m in self.modifiers) if m is not None]
        of = lambda kind: [m for m in stack if m.kind == kind]
        if of("prune-low-contribution"):
            # one score for all prune filters, drawn once however often the stack reads it; each counts what the others left. Keys and
            # scores alone go through the filters, so that the records themselves are read once, after what the stack leaves out of them
            score = rendered_contributions(df, ["chunk_id"], "splat_id").withColumnRenamed("score", "_score")
            left = _kept(df.select("chunk_id", "splat_id").join(score, "splat_id"))
            for m in of("prune-low-contribution"):
                left = prune_budget(left, ["chunk_id"], F.col("_score"), "splat_id", m.params.get("percent", 15.0), m.params.get("protect_above", 0.25))
            df = df.join(left.select("splat_id"), "splat_id", "left_semi").select(*df.columns)
        if of("erase") and picks is not None:
            df = df.join(picks.select("chunk_id", "record_id").distinct(), ["chunk_id", "record_id"], "left_anti")
        turns = []
        for m in of("animate-transform"):
            pose = keyed_transform([(k["frame"], _pose(k)) for k in m.params.get("keys", [])], frame).matrix()
            df = df.withColumns(dict(zip("xyz", apply_affine(pose, F.col("x"), F.col("y"), F.col("z")))))
            if not np.allclose(pose[:3, :3], np.eye(3)) and {"qx", "qy", "qz", "qw"} <= set(df.columns):
                turns.append(pose[:3, :3])
        colours = of("colour")
        matrix = fold_matrices([m.matrix() for m in colours])
        seen = apply_linear(matrix, F.col("r"), F.col("g"), F.col("b"))
        keep = crop_keeps([m.params for m in of("crop")])
        above = False
        for m in stack:
            above = above or m.kind == "colour"
            if m.kind == "remove-green":
                p = m.params
                keep = keep & ~green_matches(*(seen if above else [F.col(c) for c in "rgb"]), p.get("minimum_saturation", 0.5), p.get("hue_tolerance", 45.0), p.get("linear", True))
        if of("crop") or of("remove-green"):
            df = df.where(keep)
        for turn in turns:  # crops and green filters don't read what this changes
            df = covariance_bake(df, turn)
        for m in of("purge-isolated"):
            df = purge_isolated(_kept(df), ["chunk_id"], m.params.get("neighbour", 4), m.params.get("median_percent", 700.0))
        if colours:
            # neutral stacks leave the columns alone
            for m in [m for m in colours if m.params.get("despill")]:
                settings = {k: m.params[k] for k in ("gate", "strength", "green_gain", "chroma") if k in m.params}
                df = df.withColumns(dict(zip("rgb", despill(F.col("r"), F.col("g"), F.col("b"), **settings))))
            if not np.allclose(matrix, np.eye(3)):
                df = df.withColumns(dict(zip("rgb", apply_linear(matrix, F.col("r"), F.col("g"), F.col("b")))))
            opacity = float(np.prod([m.params.get("opacity", 1.0) for m in colours]))
            if opacity != 1:
                df = df.withColumn("o", F.col("o") * opacity)
        size = max((bake_size(m.params.get("distance", 2.5), m.params.get("height", 1080)) for m in of("bake-antialiasing")), default=0.0)
        if size > 0:
            scales, o = antialias_bake([F.col("sx"), F.col("sy"), F.col("sz")], F.col("o"), size)
            df = df.withColumns({"sx": scales[0], "sy": scales[1], "sz": scales[2], "o": o})
        return df


def _kept(df: DataFrame) -> DataFrame:
    """``df``, worked out once and now: readers that start together, on several machines, would each work it out."""
    df = df.persist()
    df.count()
    return df


def purge_isolated(df: DataFrame, groups: list[str], neighbour: int = 4, median_percent: float = 700.0) -> DataFrame:
    """Rows whose ``neighbour``-th nearest other row of the group is not farther than the share of the group's upper median of
    that distance. Groups of no more rows than ``neighbour``, or whose median is 0, keep all."""
    far = nth_neighbour_distances(df, groups, "splat_id", neighbour).persist()
    mid = upper_medians(far, groups, "distance")
    bad = far.join(mid, groups).where((F.col("upper_median") > 0) & (F.col("distance") > F.col("upper_median") * (median_percent / 100.0)))
    return df.join(bad.select("splat_id"), "splat_id", "left_anti")


def dump(pipeline: Pipeline) -> str:
    return json.dumps([asdict(m) for m in pipeline.modifiers], sort_keys=True)


def load(text: str) -> Pipeline:
    return Pipeline(tuple(Modifier(**m) for m in json.loads(text)))
