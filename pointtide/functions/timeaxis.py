"""Ticks, seconds, playback and fades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["ticks_at", "playback", "weight_at", "covers", "smoothstep", "keyed"]


def ticks_at(seconds: Column, numerator: Column, denominator: Column) -> Column:
    """The tick of an instant; a quotient within a billionth of a whole tick is that tick."""
    t = seconds / (numerator / denominator)
    near = F.floor(t + 0.5).cast("double")
    return F.when(F.abs(t - near) <= F.greatest(F.lit(1.0), F.abs(near)) * 1e-9, near).otherwise(t)


def playback(mode: Column, elapsed: Column, duration: Column, frame_rate: Column, phase: float = 0.0, speed: float = 1.0) -> Column:
    """Seconds of the capture shown after ``elapsed`` seconds: once, loop (with one frame between the ends) or ping-pong."""
    s = duration * phase + elapsed * speed
    period = duration + F.when(frame_rate > 0, F.lit(1.0) / frame_rate).otherwise(F.lit(0.0))
    turn = F.pmod(s, duration * 2)
    mapped = F.when(duration <= 0, s).when(mode == "loop", F.pmod(s, period)).when(mode == "pingpong", F.when(turn > duration, duration * 2 - turn).otherwise(turn)).otherwise(s)
    return F.least(F.greatest(mapped, F.lit(0.0)), duration)


def covers(frame: Column, start: Column, end: Column) -> Column:
    """Whether a range holds the frame; a negative end of the range is open."""
    return ((start < 0) | (frame >= start - 1e-6)) & ((end < 0) | (frame <= end + 1e-6))


def weight_at(frame: Column, start: Column, end: Column, fade_in: Column, fade_out: Column) -> Column:
    """Strength of a range at a frame, ramping over whole frames at both ends; the fade-out needs a closed end."""
    rise = F.when(fade_in > 0, (frame - F.greatest(F.lit(0), start) + 1) / (fade_in + 1)).otherwise(F.lit(1.0))
    fall = F.when((fade_out > 0) & (end >= 0), (end - frame + 1) / (fade_out + 1)).otherwise(F.lit(1.0))
    return F.when(covers(frame, start, end), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise, fall))).otherwise(F.lit(0.0))


def smoothstep(t: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return c * c * (F.lit(3.0) - c * 2)


def keyed(frame: Column, keys: list[tuple[float, float]]) -> Column:
    """Linear interpolation between keys (frame, value), held before the first and after the last."""
    keys = sorted(keys)
    if not keys:
        raise ValueError("no keys")
    out = F.lit(float(keys[-1][1]))
    for (f0, v0), (f1, v1) in reversed(list(zip(keys, keys[1:]))):
        a = (frame - f0) / (f1 - f0)
        out = F.when(frame < f1, (F.lit(1.0) - a) * v0 + a * v1).otherwise(out)
    return F.when(frame <= keys[0][0], F.lit(float(keys[0][1]))).otherwise(out)
