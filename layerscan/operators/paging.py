"""Previews, positions and pages of a layer in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.operators.ordering import (
    TIES,
    KeyLayout,
    in_order,
    key_at,
    key_layout,
    with_position,
    with_ties,
)

# Rows shown by default, rows of the first page, rows of each later page.
PREVIEW_ROWS = 10
FIRST_PAGE_ROWS = 200
NEXT_PAGE_ROWS = 500


def feature_rows(df: DataFrame, key: str, geometry: Column | None = None) -> DataFrame:
    """Rows as features: ``fid``, all attributes, then the geometry name (null without one).

    An attribute that is itself called ``fid`` or ``geometry`` gets the suffix ``_1``.
    """
    attributes = [
        F.col(f"`{c}`").alias(f"{c}_1" if c.lower() in ("fid", "geometry") else c) for c in df.columns
    ]
    shape = F.lit(None).cast("string") if geometry is None else geometry
    return df.select(F.col(key).alias("fid"), *attributes, shape.alias("geometry"))


def preview(
    df: DataFrame, key: str, limit: int = PREVIEW_ROWS, keys: DataFrame | None = None
) -> DataFrame:
    """The first ``limit`` rows in order; none when the limit is not positive.

    The key column is read first to find the last key of the preview, so that the scan of all
    columns can skip every row group behind it. Of the rows that share that key, the
    first in order stay. ``keys`` may give that column for a source that does not prune
    columns by itself.
    """
    if limit <= 0:
        return df.limit(0)
    first = (df if keys is None else keys).select(key).orderBy(F.col(key).asc_nulls_first())
    last = first.limit(limit).agg(F.max(key)).first()[0]
    near = F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= last)
    return df.where(near).orderBy(*in_order(df, key)).limit(limit)


def preview_summary(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """Rows in the layer and rows a preview of ``limit`` would show, from one count."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_features"),
        F.least(F.lit(max(limit, 0)).cast("bigint"), total).alias("showing"),
    )


def scan_from(df: DataFrame, key: str, skip: int, keys: DataFrame | None = None) -> DataFrame:
    """All rows from a position on.

    The position is turned into a key first, and the scan then filters on that key, which
    reaches the file reader. Only where the position lies among rows that share a key is a second
    step needed: the same on the hashes of these rows. ``keys`` as for :func:`preview`.
    """
    if skip <= 0:
        return df
    start = key_at(df if keys is None else keys, key, skip)
    if start is None:
        return df.where(F.lit(False))
    later = F.col(key).isNotNull() if start.key is None else F.col(key) > start.key
    here = F.col(key).isNull() if start.key is None else F.col(key) == start.key
    if start.before == skip:
        return df.where(here | later)
    tied, left_out, rest = with_ties(df), skip - start.before, later
    for tie in TIES:
        among = key_at(tied.where(here), tie, left_out)
        rest = rest | (here & (F.col(tie) > among.key))
        here, left_out = here & (F.col(tie) == among.key), left_out - among.before
    # Rows that are equal in everything: any of them may be left out.
    equal = tied.where(here)
    left = equal.count() - left_out
    return tied.where(rest).unionByName(equal.limit(left)).drop(*TIES)


def page_of(position: Column) -> Column:
    """Page 0 holds the first 200 rows, each later page 500."""
    later = F.floor((position - FIRST_PAGE_ROWS) / NEXT_PAGE_ROWS) + 1
    return F.when(position < FIRST_PAGE_ROWS, F.lit(0)).otherwise(later).cast("bigint")


def assign_pages(df: DataFrame, key: str, layout: KeyLayout | None = None) -> DataFrame:
    """Add ``position`` and ``page`` to every row."""
    return with_position(df, key, layout).withColumn("page", page_of(F.col("position")))


def page_progress(df: DataFrame, key: str) -> DataFrame:
    """Per page: its rows, its first and last key, and rows loaded so far out of the total.

    Positions have no gaps, so the rows loaded after a page follow from its number. A
    running sum over all pages would not do: their number grows with the layer.
    """
    layout = key_layout(df, key)
    pages = (
        assign_pages(df.select(key), key, layout)
        .groupBy("page")
        .agg(F.count(F.lit(1)).alias("page_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    )
    total = F.lit(layout.total).cast("bigint")
    through = F.lit(FIRST_PAGE_ROWS) + F.col("page") * NEXT_PAGE_ROWS
    return pages.select(
        "*", F.least(total, through).cast("bigint").alias("loaded"), total.alias("total_features")
    )
