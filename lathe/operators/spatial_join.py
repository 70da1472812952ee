"""Spatial join: grid cells of bounding boxes as an equi-join, then the exact predicate."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions import geometry as G
from lathe.functions.spatial import _geo, udf


def _cells(size: float):
    @F.pandas_udf("array<struct<x: long, y: long>>")
    def cells(text: pd.Series) -> pd.Series:
        def of(t):
            b = G.bounds(_geo(t)) if t is not None else None
            if b is None:
                return []
            lo, hi = [math.floor(v / size) for v in b[:2]], [math.floor(v / size) for v in b[2:]]
            return [{"x": x, "y": y} for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1)]

        return text.map(of, na_action=None)

    return cells


def spatial_join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, predicate: str = "st_intersects", cell: float = 1.0) -> DataFrame:
    """Rows of left and right (with different column names) whose geometries satisfy predicate.

    Each row goes to the grid cells that its bounding box meets; a pair is tested only in the cell where both boxes
    first meet, so it is found once and without a cross join. cell: the grid's width, about a typical box's.
    Rows without a geometry match nothing.
    """
    low_of = lambda c, axis: F.array_min(F.transform(F.col(c), lambda v: v[axis]))

    def spread(d: DataFrame, column: str, side: str) -> DataFrame:
        own = d.withColumn(f"_cells_{side}", _cells(cell)(column))
        low = own.select("*", low_of(f"_cells_{side}", "x").alias(f"_x_{side}"), low_of(f"_cells_{side}", "y").alias(f"_y_{side}"))
        return low.select(*[c for c in low.columns if c != f"_cells_{side}"], F.explode(f"_cells_{side}").alias(f"_cell_{side}"))

    a, b = spread(left, left_geometry, "a"), spread(right, right_geometry, "b")
    pairs = a.join(b, F.col("_cell_a") == F.col("_cell_b"))
    first = (F.col("_cell_a.x") == F.greatest("_x_a", "_x_b")) & (F.col("_cell_a.y") == F.greatest("_y_a", "_y_b"))
    return pairs.filter(first).filter(udf(predicate)(left_geometry, right_geometry)).select(*left.columns, *right.columns)
