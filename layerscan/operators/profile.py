"""Extents, counts and per-band statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concat_layers(parts: list[DataFrame]) -> DataFrame:
    """All rows of several layers, columns matched by name."""
    return reduce(DataFrame.unionByName, parts)


def extent_of(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """Aggregate: bounding box of boxes; null when no row has one.

    Adding zero turns -0.0, which compares equal to 0.0, into the same edge every time.
    """
    edges = F.min(xmin), F.max(xmax), F.min(ymin), F.max(ymax)
    low_x, high_x, low_y, high_y = (edge + F.lit(0.0) for edge in edges)
    box = F.struct(
        low_x.cast("double").alias("xmin"),
        high_x.cast("double").alias("xmax"),
        low_y.cast("double").alias("ymin"),
        high_y.cast("double").alias("ymax"),
    )
    return F.when(low_x.isNotNull() & low_y.isNotNull(), box)


def _one_row_each(layers: dict[str, DataFrame]) -> DataFrame:
    """One row per layer name, so that an empty layer still gets its line."""
    session = next(iter(layers.values())).sparkSession
    names = F.array(*[F.lit(name) for name in layers])
    return session.range(1).select(F.explode(names).alias("layer"))


def layer_extents(layers: dict[str, DataFrame], axes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Row count and extent per layer.

    Each layer is cut down to its two coordinates before the union, so one partial
    aggregation runs right behind the scans and one small exchange ends it.
    """
    points = [
        layers[name].select(
            F.lit(name).alias("layer"),
            F.lit(1).alias("n"),
            x.cast("double").alias("x"),
            y.cast("double").alias("y"),
        )
        for name, (x, y) in axes.items()
    ]
    seeds = _one_row_each({name: layers[name] for name in axes}).select(
        "layer", F.lit(0).alias("n"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")
    )
    x, y = F.col("x"), F.col("y")
    return (
        concat_layers([*points, seeds])
        .groupBy("layer")
        .agg(F.sum("n").alias("feature_count"), extent_of(x, x, y, y).alias("extent"))
    )


def array_bands(df: DataFrame, values: str, keep: list[str] | None = None) -> DataFrame:
    """An array column as pixels: one row per element, its 1-based place being the band."""
    place, value = F.col("_place"), F.col("_value")
    return df.select(*(keep or []), F.posexplode(values).alias("_place", "_value")).select(
        *(keep or []), (place + 1).alias("band"), value.cast("double").alias("value")
    )


def _without_empty(valid: Column, stats: dict[str, Column]) -> list[Column]:
    """Statistics are left out for a band without valid pixels or with all four at zero."""
    blank = (valid == 0) | reduce(lambda a, b: a & b, [s == 0 for s in stats.values()])
    return [F.when(~blank, s).alias(name) for name, s in stats.items()]


def band_stats(pixels: DataFrame, by: list[str], nodata: float | Column | None = None) -> DataFrame:
    """Exact minimum, maximum, mean and population deviation per band of a pixel table.

    NaN and nodata pixels do not count. The aggregate is partial before the shuffle, so a
    band that holds most pixels costs no more than any other.
    """
    value = F.col("value")
    usable = ~F.isnan(value)
    if nodata is not None:
        hole = nodata if isinstance(nodata, Column) else F.lit(float(nodata))
        usable = usable & (hole.isNull() | (value != hole))
    kept = F.when(usable, value)
    sums = pixels.groupBy(*by).agg(
        F.count(kept).alias("valid"),
        F.min(kept).alias("min"),
        F.max(kept).alias("max"),
        F.avg(kept).alias("mean"),
        F.stddev_pop(kept).alias("stddev"),
    )
    stats = {name: F.col(name) for name in ("min", "max", "mean", "stddev")}
    return sums.select(*by, F.col("valid").alias("valid_count"), *_without_empty(F.col("valid"), stats))


MERGE_SHARDS = 64


def _merge_once(parts: DataFrame, by: list[str]) -> DataFrame:
    """Pieces of one group as one piece; the window and the aggregate share an exchange."""
    group = Window.partitionBy(*by)
    n = F.col("valid")
    mean = F.sum(n * F.col("mean")).over(group) / F.nullif(F.sum(n).over(group), F.lit(0))
    off = F.col("mean") - F.col("_mean")
    return (
        parts.withColumn("_mean", mean)
        .groupBy(*by)
        .agg(
            F.sum(n).alias("valid"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.sum(F.col("m2") + n * off * off).alias("m2"),
            F.max("_mean").alias("mean"),
            F.max("error").alias("error"),
        )
    )


def merge_band_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """Band statistics from partial ones: ``valid, min, max, mean, m2`` per piece.

    ``m2`` is the sum of squared distances from the piece's own mean. A piece stands for
    a whole group of raster blocks. Pieces are merged in two rounds, the first over
    shards of each group, so that a group with most of the pieces does not end up in one
    task. A piece that could not be read only brings its ``error``.
    """
    shard = F.pmod(F.xxhash64("path", "valid", "mean"), F.lit(MERGE_SHARDS)).cast("int")
    sums = _merge_once(_merge_once(parts.withColumn("_shard", shard), [*by, "_shard"]), by)
    total = F.nullif(F.col("valid"), F.lit(0))
    stats = {
        "min": F.col("min"),
        "max": F.col("max"),
        "mean": F.col("mean"),
        "stddev": F.sqrt(F.col("m2") / total),
    }
    kept = _without_empty(F.col("valid"), stats)
    return sums.select(*by, F.col("valid").alias("valid_count"), *kept, "error")
