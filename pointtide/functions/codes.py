"""Numbers as codes: half precision, logarithmic opacities, normals on an octahedron, wide values, harmonics of lower degree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

__all__ = ["half", "half_bits", "half_rank", "opacity_code", "opacity_of", "ranked_axes", "normal_code", "normal_of", "split_wide", "join_wide", "HARMONICS", "to_degree", "least_degree"]

#: Coefficients per channel of harmonics of degree 0 to 3, without the constant.
HARMONICS = (0, 3, 8, 15)


def _exponent(a: Column) -> Column:
    """The power of 2 at or below a positive number, by the logarithm and a step where that is rounded."""
    e = F.floor(F.log2(a)).cast("int")
    e = e + F.when(F.pow(F.lit(2.0), e + 1) <= a, 1).when(F.pow(F.lit(2.0), e) > a, -1).otherwise(0)
    return F.greatest(e, F.lit(-14))


def half(c: Column) -> Column:
    """The nearest number of half precision, ties away from zero; beyond the largest it is infinite. Null stays null."""
    a = F.abs(c)
    step = F.pow(F.lit(2.0), _exponent(a) - 10)
    near = F.floor(a / step + 0.5) * step
    return F.when(a == 0, F.lit(0.0)).when(a < 65520, F.signum(c) * near).when(c.isNotNull(), F.signum(c) * float("inf"))


def half_bits(c: Column) -> Column:
    """The 16 bits of a finite number of half precision."""
    a = F.abs(c)
    e = _exponent(a)
    whole = F.round(a / F.pow(F.lit(2.0), e - 10)).cast("int")
    code = F.when(a == 0, 0).when(whole < 1024, whole).otherwise((e + 15) * 1024 + whole - 1024)
    return code + F.when(c < 0, 32768).otherwise(0)


def half_rank(bits: Column) -> Column:
    """A number that orders 16-bit codes as the numbers they stand for; its own inverse is the same rule read backwards."""
    return F.when(bits >= 32768, F.lit(65535) - bits).otherwise(bits + 32768)


def opacity_code(o: Column) -> Column:
    """Sixteenths of a halving, 0 to 255; 255 for what is not positive."""
    return F.when(o > 0, F.least(F.lit(255), F.floor(F.log2(F.least(o, F.lit(1.0))) * -16.0 + 0.5).cast("int"))).otherwise(255)


def opacity_of(code: Column) -> Column:
    return F.pow(F.lit(2.0), -code / 16.0)


def ranked_axes(scales: list[Column]) -> Column:
    """The axes from the shortest to the longest, ties to the lower axis, as an array of 0 to 2."""
    return F.transform(F.array_sort(F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scales)])), lambda a: a["i"])


def normal_code(v: list[Column], axes: Column) -> tuple[Column, Column]:
    """(u in 0..255, v in 0..127 above the sign) of a direction in the record's axes: the half octahedron about the shortest axis."""
    parts = F.array(*v)
    z, x, y = (F.get(parts, F.get(axes, F.lit(i))) for i in range(3))
    size = F.abs(x) + F.abs(y) + F.abs(z)
    level = lambda c, top: clamp(F.floor((c + 1) * 0.5 * top + 0.5), 0.0, float(top)).cast("int")
    some = size > 0
    low = level((x - y) / size, 127) * 2 + F.when(z < 0, 1).otherwise(0)
    return F.when(some, level((x + y) / size, 255)).otherwise(128), F.when(some, low).otherwise(128)


def normal_of(u: Column, v: Column, axes: Column) -> list[Column]:
    """The unit direction that a code stands for."""
    a, b = u / 255.0 * 2 - 1, F.floor(v / 2) / 127.0 * 2 - 1
    x, y = (a + b) * 0.5, (a - b) * 0.5
    z = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x) - F.abs(y)) * F.when(v % 2 == 1, -1.0).otherwise(1.0)
    n = F.sqrt(x * x + y * y + z * z)
    place = lambda i: F.array_position(axes, F.lit(i))
    return [F.when(place(i) == 1, z).when(place(i) == 2, x).otherwise(y) / n for i in range(3)]


def split_wide(v: Column, bits: int) -> tuple[Column, Column]:
    """(symbol, raw low bits) of a whole number that is not negative."""
    return F.shiftright(v, bits), v.bitwiseAND(F.lit((1 << bits) - 1))


def join_wide(high: Column, low: Column, bits: int) -> Column:
    return F.shiftleft(high, bits).bitwiseOR(low)


def to_degree(c: Column, degree: int) -> Column:
    """Coefficients of a channel cut to a degree, or grown to it with zeros."""
    n = HARMONICS[degree]
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), n)), 1, n)


def least_degree(c: Column, tolerance: float) -> Column:
    """The least degree (0 to 3) whose missing coefficients have a root mean square, over all 15, of at most ``tolerance``."""
    square = lambda n: F.aggregate(F.slice(c, n + 1, 15), F.lit(0.0), lambda a, v: a + v * v)
    fits = lambda d: F.sqrt(square(HARMONICS[d]) / 15) <= tolerance
    return F.when(fits(0), 0).when(fits(1), 1).when(fits(2), 2).otherwise(3)
