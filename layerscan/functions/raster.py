"""Raster geometry from the six-number affine geotransform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raster_extent(origin_x: Column, step_x: Column, origin_y: Column, step_y: Column,
                  columns: Column, rows: Column) -> Column:
    """Extent struct from origin and step; rotation is ignored, and a south-up grid
    keeps ``ymin > ymax`` just as its geotransform says."""
    complete = origin_x.isNotNull() & step_x.isNotNull() & origin_y.isNotNull() & step_y.isNotNull()
    return F.when(
        complete,
        F.struct(
            origin_x.cast("double").alias("xmin"),
            (origin_x + step_x * columns).cast("double").alias("xmax"),
            (origin_y + step_y * rows).cast("double").alias("ymin"),
            origin_y.cast("double").alias("ymax"),
        ),
    )


def cell_size(step: Column) -> Column:
    return F.abs(step)
