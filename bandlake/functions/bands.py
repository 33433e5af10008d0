"""Column functions on band arrays (row-major, 32-bit floats) and on pyramid sizes.

Division gives doubles in Spark, so quotients are cast back at once: rounding the double quotient of two floats is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 7
MIN_SIDE = 256


def f32(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def quantize(value: Column) -> Column:
    """0..1 to a byte by truncation; NaN is 0, other values are clamped."""
    return (F.least(F.greatest(F.nanvl(value, f32(0.0)), f32(0.0)), f32(1.0)) * f32(255.0)).cast("int")


def num_layers(bands: Column) -> Column:
    """Four bands to a layer, two layers at least."""
    return F.greatest(F.floor((bands + 3) / 4).cast("int"), F.lit(2))


def pixel_count(width: Column, height: Column) -> Column:
    """Null where the product overflows 32 unsigned bits."""
    product = F.try_multiply(width.cast("long"), height.cast("long"))
    return F.when(product <= (1 << 32) - 1, product)


def bilinear(px: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """The corner is clamped to the grid, the fraction comes from the unclamped coordinate."""

    def axis(at: Column, size: Column) -> tuple[Column, Column, Column]:
        low = F.floor(at)
        first = F.least(F.greatest(low, F.lit(0)), size - 1)
        part = F.least(F.greatest(at - f32(low), f32(0.0)), f32(1.0))
        return first, F.least(first + 1, size - 1), part

    x0, x1, fx = axis(x, width)
    y0, y1, fy = axis(y, height)
    value = lambda r, c: F.get(px, (r * width + c).cast("int"))
    one = f32(1.0)
    upper = value(y0, x0) * (one - fx) + value(y0, x1) * fx
    lower = value(y1, x0) * (one - fx) + value(y1, x1) * fx
    return upper * (one - fy) + lower * fy


def resample(px: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Bilinear at half-pixel centres; the same size is the same array."""
    step_x, step_y = f32(f32(width) / f32(to_width)), f32(f32(height) / f32(to_height))
    half = f32(0.5)

    def pixel(k: Column) -> Column:
        x = (f32(k % to_width) + half) * step_x - half
        y = (f32(F.floor(k / to_width)) + half) * step_y - half
        return bilinear(px, width, height, x, y)

    same = (width == to_width) & (height == to_height)
    return F.when(same, px).otherwise(F.transform(F.sequence(F.lit(0), (to_width * to_height).cast("int") - 1), pixel))


def floor_size(side: Column, level: Column) -> Column:
    """Side at a level, rounded down, 1 at least."""
    return F.greatest(F.floor(side / F.pow(F.lit(2), level)).cast("int"), F.lit(1))


def ceil_size(side: Column, level: Column) -> Column:
    """Side after halving ``level`` times, rounded up each time."""
    return F.ceil(side / F.pow(F.lit(2), level)).cast("int")


def num_levels(width: Column, height: Column, min_side: int = MIN_SIDE) -> Column:
    """How many halvings, and one, until both sides are at most ``min_side``."""
    longest = F.greatest(width, height).cast("long")
    fits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda n: F.lit(min_side).cast("long") * F.pow(F.lit(2), n).cast("long") >= longest)
    return F.element_at(fits, 1) + 1


def clamp_level(level: Column, most: Column | int = MAX_LEVEL) -> Column:
    return F.least(level, F.lit(MAX_LEVEL), most if isinstance(most, Column) else F.lit(most))


def progressive_levels(target: Column, most: Column, progressive: Column) -> Column:
    """Levels to send, coarse to fine: all from ``most`` if progressive and the target is above 0, else the target."""
    level = F.least(target, most)
    return F.when(progressive & (level > 0), F.sequence(most, level, F.lit(-1))).otherwise(F.array(level))


def row_chunks(height: Column, rows: int = 128) -> Column:
    """Consecutive (start, end) row ranges, the last one short."""
    return F.transform(F.sequence(F.lit(0), height - 1, F.lit(rows)), lambda a: F.struct(a.alias("start"), F.least(a + rows, height).alias("end")))


def thumbnail_size(width: Column, height: Column, most: int = 256) -> tuple[Column, Column]:
    longest = F.greatest(width, height)
    scaled = lambda side: F.when(longest <= most, side).otherwise(F.greatest(F.round(side * (F.lit(float(most)) / longest)), F.lit(1)).cast("int"))
    return scaled(width), scaled(height)
