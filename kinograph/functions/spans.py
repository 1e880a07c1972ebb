"""Inclusive frame spans and clip time as Column expressions; every rounding goes half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """The value with so many places (5 at most), as Python rounds it: by the exact value of the double, halves to even.

    The part of value * 10^places that the product loses is found by cutting the value into two halves of its digits, each of
    which is multiplied without loss.
    """
    scale = float(10**places)
    big = value * 134217729.0
    high = big - (big - value)
    product = value * scale
    lost = (high * scale - product) + (value - high) * scale
    below = F.floor(product).cast("double")
    over = (product - below - 0.5) + lost
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(below, F.lit(2.0)))
    return F.when(F.abs(value) < 1e10, (below + up) / scale).otherwise(value)


def to_frames(seconds: Column | float, fps: Column) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.rint(seconds * fps).cast("int")


def to_seconds(frame: Column, fps: Column, places: int | None = 3) -> Column:
    out = F.try_divide(frame.cast("double"), fps)
    return out if places is None else rounded(out, places)


def smooth_frames(window_s: float, fps: Column) -> Column:
    return F.greatest(to_frames(window_s, fps), F.lit(3))


def length_s(start: Column, end: Column, fps: Column) -> Column:
    return F.try_divide((end - start + 1).cast("double"), fps)


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """IoU of inclusive spans; 0 where they don't meet."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    union = (a1 - a0 + 1) + (b1 - b0 + 1) - inter
    return F.when((inter > 0) & (union > 0), F.try_divide(inter.cast("double"), union.cast("double"))).otherwise(0.0)


def pad(start: Column, end: Column, frames: Column, n_frames: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), start - frames), F.least(n_frames - 1, end + frames)


def sample(start: Column, end: Column, n: int) -> Column:
    """n evenly spaced frames with both ends, distinct and in order; all frames of a span that has n or fewer; the middle for 1."""
    size = end - start + 1
    if n <= 0:
        return F.when(start.isNotNull(), F.array().cast("array<int>"))
    if n == 1:
        return F.when(size > 0, F.array((start + F.floor(size / 2)).cast("int"))).otherwise(F.array().cast("array<int>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(start + k * (end - start) / F.lit(float(n - 1))).cast("int"))
    return F.when(size <= 0, F.array().cast("array<int>")).when(size <= n, F.sequence(start.cast("int"), end.cast("int"))).otherwise(F.array_sort(F.array_distinct(spread)))


def tile_origins(size: int | Column, tile: int, overlap: float) -> Column:
    """Where tiles begin along one side; the last one ends flush with the side."""
    size = size if isinstance(size, Column) else F.lit(size)
    step = max(1, round(tile * (1 - overlap)))
    last = size - tile
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(F.greatest(last, F.lit(0))))))
