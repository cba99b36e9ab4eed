"""Bit fields, zigzag, Morton order and integer hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["quantise", "dequantise", "pack", "unpack", "zigzag", "unzigzag", "morton3", "multiply_u32", "mix_u32", "pack_runs"]


def quantise(c: Column, lo: Column, hi: Column, bits: int) -> Column:
    """Nearest of 2**bits evenly spaced levels from lo to hi; 0 where the range is empty."""
    top = (1 << bits) - 1
    t = F.when(hi > lo, (c - lo) / (hi - lo) * top).otherwise(F.lit(0.0))
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(t + 0.5))).cast("bigint")


def dequantise(q: Column, lo: Column, hi: Column, bits: int) -> Column:
    return lo + q * ((hi - lo) / ((1 << bits) - 1))


def pack(fields: list[tuple[Column, int]]) -> Column:
    """Fields (value, bits) side by side in one bigint, the first lowest."""
    out, at = None, 0
    for c, bits in fields:
        part = F.shiftleft(c.cast("bigint"), at)
        out = part if out is None else out.bitwiseOR(part)
        at += bits
    return out


def unpack(word: Column, widths: list[int]) -> list[Column]:
    out, at = [], 0
    for bits in widths:
        out.append(F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << bits) - 1)))
        at += bits
    return out


def zigzag(c: Column) -> Column:
    """Small numbers of either sign become small numbers from 0."""
    return F.shiftleft(c.cast("bigint"), 1).bitwiseXOR(F.shiftright(c.cast("bigint"), 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1)))


def _spread(c: Column) -> Column:
    """21 bits moved three places apart."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three 21-bit numbers, x lowest."""
    return _spread(x.cast("bigint")).bitwiseOR(F.shiftleft(_spread(y.cast("bigint")), 1)).bitwiseOR(F.shiftleft(_spread(z.cast("bigint")), 2))


def multiply_u32(a: Column, k: int) -> Column:
    """a * k modulo 2**32 without overflow of a bigint; a from 0 to 2**32 - 1."""
    low = F.lit(0xFFFFFFFF)
    high = (a * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + a * F.lit(k & 0xFFFF)).bitwiseAND(low)


def mix_u32(c: Column) -> Column:
    """A 32-bit hash of an integer: a golden-ratio multiply and the common two-round finaliser."""
    # fixed values: 2**32 over the golden ratio; the finaliser's shifts and factors
    x = multiply_u32(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), 0x9E3779B1)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = multiply_u32(x.bitwiseXOR(F.shiftrightunsigned(x, shift)), factor)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def pack_runs(ids: Column) -> Column:
    """A sorted array of different integers as runs (start, length)."""
    step = lambda acc, v: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["start"] + F.element_at(acc, -1)["length"] == v),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), (F.element_at(acc, -1)["length"] + 1).alias("length")))),
    ).otherwise(F.concat(acc, F.array(F.struct(v.alias("start"), F.lit(1).cast("bigint").alias("length")))))
    return F.aggregate(ids, F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)"), step)
