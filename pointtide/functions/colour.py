"""Colour arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["C0", "srgb_to_linear", "linear_to_srgb", "hue", "saturation", "green_matches", "colour_matrix", "fold_matrices", "despill", "sigmoid", "logit"]

#: Fixed value: the constant of the zeroth spherical harmonic, 1 / (2 sqrt(pi)).
C0 = 0.28209479177387814
#: Weights of red, green and blue in the luminance of Rec. 709.
LUMA = (0.2126, 0.7152, 0.0722)


def bind(values: dict, then):
    """``then`` of a struct whose fields are ``values``, each evaluated once. A formula that names its inputs many times would
    otherwise copy their expressions into every place, and nested formulas outgrow generated code."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(c: Column, edge: float = 1e-6) -> Column:
    p = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), c))
    return F.ln(p / (F.lit(1.0) - p))


def srgb_to_linear(c: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees from 0 to below 360; null for greys."""
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    h = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    return F.when(span > 0, F.when(h < 0, h + 360).otherwise(h))


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(F.lit(0.0))


def green_matches(r: Column, g: Column, b: Column, least_saturation: float = 0.5, tolerance: float = 45.0, linear: bool = True) -> Column:
    """Whether the colour is near green: saturated enough, its hue within the tolerance of 120 degrees around the circle."""
    one = srgb_to_linear if linear else (lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))

    def matches(c):
        away = F.abs(hue(c["r"], c["g"], c["b"]) - 120)
        return F.coalesce((saturation(c["r"], c["g"], c["b"]) >= least_saturation) & (F.least(away, F.lit(360.0) - away) <= tolerance), F.lit(False))

    return bind({"r": one(r), "g": one(g), "b": one(b)}, matches)


def colour_matrix(exposure: float = 0.0, temperature: float = 0.0, tint: float = 0.0, saturation: float = 1.0) -> np.ndarray:
    """White balance as gains per channel, then saturation about the luminance, then exposure."""
    warm, green = 2 ** (temperature / 4), 2 ** (tint / 4)
    mix = saturation * np.eye(3) + (1 - saturation) * np.tile(LUMA, (3, 1))
    return 2**exposure * mix @ np.diag([warm, green, 1 / warm])


def fold_matrices(stack: list[np.ndarray]) -> np.ndarray:
    """One matrix for a stack that is applied from the first to the last."""
    out = np.eye(3)
    for m in stack:
        out = m @ out
    return out


def despill(r: Column, g: Column, b: Column, gate: float = 1.0, strength: float = 1.0, green_gain: float = 1.0, chroma: float = 1.0) -> list[Column]:
    """Green spill removal in two steps. A colour of green hue is pulled towards its largest channel, each channel by the same part of
    its distance, the more the nearer the hue is to pure green; what green then stands above a mean of red and blue (drawn to the
    larger of them by the saturation to the power ``gate``) is taken off, and half of it handed back to red and blue.

    ``green_gain`` scales green before; of the result ``strength`` is mixed into the colour, and ``chroma`` scales its distance from
    its luminance."""

    def pull(c):
        keep = F.lit(1.0) - F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.lit(120.0) - c["h"]) / 60))
        part = F.when(F.coalesce((c["h"] >= 60) & (c["h"] <= 180), F.lit(False)), keep).otherwise(F.lit(1.0))
        return F.struct(*[(c["v"] - (c["v"] - c[n]) * part).alias(n) for n in "rgb"], F.pow(c["s"], F.lit(gate)).alias("w"))

    def hand_back(c):
        mean = lambda x, y: (F.lit(1.0) - c["w"]) * (x + y) / 2 + c["w"] * F.greatest(x, y)
        spill = c["g"] - mean(c["r"], c["b"])
        r2, b2, over = F.least(F.lit(1.0), c["r"] + spill * 0.25), F.least(F.lit(1.0), c["b"] + spill * 0.25), spill > 0
        return F.struct(F.when(over, r2).otherwise(c["r"]).alias("r"), F.when(over, mean(r2, b2)).otherwise(c["g"]).alias("g"), F.when(over, b2).otherwise(c["b"]).alias("b"))

    g1 = g if green_gain == 1 else g * green_gain
    first = bind({"r": r, "g": g1, "b": b, "h": hue(r, g1, b), "s": saturation(r, g1, b), "v": F.greatest(r, g1, b)}, pull)
    out = F.transform(F.array(first), hand_back)[0]
    made = [out[n] for n in "rgb"]
    if strength != 1:
        made = [m * strength + c * (1 - strength) for m, c in zip(made, (r, g, b))]
    if chroma != 1:
        light = sum((m * float(w) for m, w in zip(made, LUMA)), F.lit(0.0))
        made = [light + (m - light) * chroma for m in made]
    return made


def auto_green_gain(df, groups: list[str]):
    """(groups, gain): half of red and blue over green, summed over colours of middling light and little chroma, held to 0.9 to 1; 1 where
    there are none."""
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    grey = (most >= 0.15) & (most <= 0.8) & ((most - least) / most <= 0.2)
    ratio = F.sum(F.when(grey, (F.col("r") + F.col("b")) / 2)) / F.sum(F.when(grey, F.col("g")))
    return df.groupBy(*groups).agg(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.9), ratio)), F.lit(1.0)).alias("gain"))
