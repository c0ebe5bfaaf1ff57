"""Text search over every cell, with match navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.text import cell_text
from layerscan.operators.ordering import (
    BUCKET,
    TIES,
    KeyLayout,
    bucket_table,
    key_layout,
    with_bucket,
    with_ties,
)

DIGITS = "0123456789"

# The characters the text of a value can be made of; none of them is a capital letter.
ALPHABETS = {
    T.ByteType: DIGITS + "-",
    T.ShortType: DIGITS + "-",
    T.IntegerType: DIGITS + "-",
    T.LongType: DIGITS + "-",
    T.DoubleType: DIGITS + "+-.e" + "nan" + "inf",
    T.FloatType: DIGITS + "+-.e" + "nan" + "inf",
    T.DateType: DIGITS + "+-",
    T.TimestampNTZType: DIGITS + "+-.: ",
}


def row_matches(df: DataFrame, query: str, columns: list[str] | None = None) -> Column:
    """True for rows where some cell contains the query, ignoring case.

    A null cell never matches and an empty query matches nothing. The conditions are
    joined with OR, which stays inside generated code; an array of cells would not. A
    column whose text cannot hold every character of the query is not looked at: words
    are not searched for in numbers.
    """
    if not query:
        return F.lit(False)
    wanted = F.lower(F.lit(query))
    found = F.lit(False)
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, T.BinaryType):
            continue
        alphabet = ALPHABETS.get(type(field.dataType))
        if alphabet and not set(query.lower()) <= set(alphabet):
            continue
        cell = cell_text(F.col(f"`{field.name}`"), field.dataType)
        cell = cell if alphabet else F.lower(cell)
        found = found | F.coalesce(cell.contains(wanted), F.lit(False))
    return found


def search_rows(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """The rows with a matching cell: one pass over the scan, no shuffle."""
    return df.where(row_matches(df, query, columns))


def match_ring(
    df: DataFrame,
    key: str,
    query: str,
    columns: list[str] | None = None,
    layout: KeyLayout | None = None,
) -> DataFrame:
    """For every matching row its place among the matches and the next and previous match.

    Next and previous wrap round; a single match is its own neighbour. The search runs
    once: the matching keys are shuffled by bucket, and both the per-bucket table and the
    window inside each bucket read that same exchange.
    """
    layout = layout or key_layout(df, key)
    tied = with_ties(df)
    names = df.columns if columns is None else columns
    matches = search_rows(tied, query, names).select(key, *TIES)
    bucketed = with_bucket(matches, key, layout, F.col(TIES[0])).repartition(BUCKET)
    links = bucket_table(bucketed, key)
    inside = Window.partitionBy(BUCKET).orderBy(F.col(key).asc_nulls_first(), *TIES)
    # Bounded: one row per bucket, see MAX_BUCKETS.
    return bucketed.join(F.broadcast(links), BUCKET).select(
        F.col(key),
        (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint").alias("match_index"),
        F.coalesce(F.lead(key).over(inside), F.col("_next_first")).alias("next_key"),
        F.coalesce(F.lag(key).over(inside), F.col("_prev_last")).alias("prev_key"),
    )
