"""Neighbourhood windows over dense cells(row, col, value): one axis at a time, explicit edges.

A window is read with an ordinary SQL window over one row or column of the raster, so
rows of a raster are independent tasks; edges are padded inside the expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(axis: str, keys: tuple[str, ...]) -> Window:
    along, across = ("col", "row") if axis == "x" else ("row", "col")
    return Window.partitionBy(*keys, across).orderBy(along)


def neighbours(value: str, axis: str, radius: int, size: int, edge: str = "nearest", keys: tuple[str, ...] = ()) -> Column:
    """Array of the ``2 * radius + 1`` values around each cell; edges: nearest, reflect (the edge cell repeats), constant0."""
    line = _line(axis, keys)
    along = F.col("col" if axis == "x" else "row")
    held = F.collect_list(F.coalesce(F.col(value), F.lit(float("nan")))).over(line.rowsBetween(-radius, radius))
    left, right = F.greatest(F.lit(radius) - along, F.lit(0)), F.greatest(along + radius - (size - 1), F.lit(0))
    if edge == "nearest":
        before, after = F.array_repeat(F.element_at(held, 1), left), F.array_repeat(F.element_at(held, -1), right)
    elif edge == "constant0":
        before, after = F.array_repeat(F.lit(0.0), left), F.array_repeat(F.lit(0.0), right)
    elif edge == "reflect":
        if radius >= size:
            raise ValueError("reflect needs a radius below the raster's size")
        before, after = F.reverse(F.slice(held, F.lit(1), left)), F.slice(F.reverse(held), F.lit(1), right)
    else:
        raise ValueError(f"unknown edge: {edge}")
    return F.concat(before, held, after)


def weighted(value: str, axis: str, weights: list[float], size: int | Column, edge: str = "nearest", keys: tuple[str, ...] = ()) -> Column:
    """Sum of the values around a cell along one axis, by weights."""
    kernel = F.array(*(F.lit(float(w)) for w in weights))
    return F.aggregate(F.zip_with(neighbours(value, axis, len(weights) // 2, size, edge, keys), kernel, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)


def convolve(cells: DataFrame, value: str, out: str, weights: list[float], shape: tuple, edge: str = "nearest", keys: tuple[str, ...] = ()) -> DataFrame:
    """Separable convolution with the same weights along x and then y; shape is (height, width)."""
    across = cells.withColumn(out, weighted(value, "x", weights, shape[1], edge, keys))
    return across.withColumn(out, weighted(out, "y", weights, shape[0], edge, keys))


def box_mean(value: str, axis: str, radius: int, size: int | Column, keys: tuple[str, ...] = ()) -> Column:
    """Mean of the values around a cell along one axis, edge cells repeated, from sums over a frame."""
    frame = _line(axis, keys).rowsBetween(-radius, radius)
    along = F.col("col" if axis == "x" else "row")
    left, right = F.greatest(F.lit(radius) - along, F.lit(0)), F.greatest(along + radius - (size - 1), F.lit(0))
    return (F.sum(value).over(frame) + left * F.first(value).over(frame) + right * F.last(value).over(frame)) / (2 * radius + 1)


def box_means(cells: DataFrame, means: dict[str, str], radius: int, shape: tuple, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each ``name: value``, the mean over the square around a cell: one window for each axis."""
    across = cells.withColumns({name: box_mean(value, "x", radius, shape[1], keys) for name, value in means.items()})
    return across.withColumns({name: box_mean(name, "y", radius, shape[0], keys) for name in means})


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def box_weights(radius: int) -> list[float]:
    return [1.0 / (2 * radius + 1)] * (2 * radius + 1)


def extreme(cells: DataFrame, value: str, out: str, radius: int, largest: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Separable window minimum or maximum; a frame cut at the edge gives the same as repeated edge cells."""
    pick = F.max if largest else F.min
    across = cells.withColumn("__m", pick(value).over(_line("x", keys).rowsBetween(-radius, radius)))
    return across.withColumn(out, pick("__m").over(_line("y", keys).rowsBetween(-radius, radius))).drop("__m")


def gradient(value: str, axis: str, pixel_size: float, keys: tuple[str, ...] = ()) -> Column:
    """Central differences, one-sided at the edges."""
    line = _line(axis, keys)
    here, before, after = F.col(value), F.lag(value).over(line), F.lead(value).over(line)
    return F.when(before.isNull(), (after - here) / pixel_size).when(after.isNull(), (here - before) / pixel_size).otherwise((after - before) / (2 * pixel_size))


def second(value: str, axis: str, keys: tuple[str, ...] = ()) -> Column:
    """Second difference along one axis; beyond an edge stands the edge cell again."""
    line, here = _line(axis, keys), F.col(value)
    return F.coalesce(F.lag(value).over(line), here) - 2 * here + F.coalesce(F.lead(value).over(line), here)


def laplace(value: str, keys: tuple[str, ...] = ()) -> Column:
    """Sum of second differences along both axes."""
    return second(value, "x", keys) + second(value, "y", keys)
