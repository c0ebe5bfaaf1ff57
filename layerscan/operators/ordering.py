"""Order by key without one global sort task.

A layer is read in the order of its row key (``fid``), nulls first; rows with the same key follow
each other by two hashes of the whole row, so that every row has one place. A window over the whole
layer would put every row into one task, so rows are dealt into buckets that follow the
order: a window runs inside each bucket, and one small table with a row per bucket (whose number
has a fixed limit) links the buckets together. A key that many rows share is cut into
buckets by the hash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 1 << 20
MAX_BUCKETS = 1 << 14
# Quantile cuts come from a sketch that one task merges, so there are fewer of them.
MAX_CUTS = 1 << 13
BUCKET = "_bucket"


TIES = ("_tie", "_tie2")


def _has_no_order(kind: T.DataType) -> bool:
    """Whether a type has maps or variants in it, which can't be hashed as they are."""
    if isinstance(kind, T.ArrayType):
        return _has_no_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_no_order(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with its maps as entries in order of their keys, and its variants as text."""
    if not _has_no_order(kind):
        return value
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(
            canonical(e["key"], kind.keyType).alias("k"), canonical(e["value"], kind.valueType).alias("v")
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    fields = [canonical(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def tie_breakers(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of the whole row, of different seeds. Equal rows are interchangeable."""
    values = [canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)


def with_ties(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(TIES, tie_breakers(df), strict=True)))


def in_order(df: DataFrame, key: str) -> list[Column]:
    """What rows are sorted by."""
    return [F.col(key).asc_nulls_first(), *tie_breakers(df)]


@dataclass(frozen=True)
class KeyLayout:
    """How the integer keys of a layer are spread. ``count`` and ``dense`` leave out nulls."""

    count: int
    low: int | None
    high: int | None
    cuts: list[float] = field(default_factory=list)
    nulls: int = 0
    # Every integer from low to high is a key exactly once, so position is ``key - low``.
    dense: bool = False
    # Keys that many rows share, with the number of buckets for each.
    shared: dict[float, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.count + self.nulls

    @property
    def buckets(self) -> int:
        if self.dense:
            return max(1, min(MAX_BUCKETS, -(-self.count // ROWS_PER_BUCKET)))
        return len(self.cuts) + 1


def _fingerprint(key: str) -> Column:
    return F.sum(F.xxhash64(F.col(key).cast("bigint")).cast("decimal(38,0)"))


def key_layout(df: DataFrame, key: str, with_cuts: bool = True) -> KeyLayout:
    """Measure the key column (a scan of that column alone).

    Keys that may be dense by count, minimum and maximum are so if the sum of their hashes is
    that of all integers in between. Other keys get cut points at approximate quantiles, so
    that each bucket holds about the same number of rows no matter how the keys bunch
    together; a quantile that comes several times is a key shared by many rows.
    """
    spark = df.sparkSession
    nulls = F.count(F.lit(1)) - F.count(key)
    count, low, high, nulls, mark = df.agg(
        F.count(key), F.min(key), F.max(key), nulls, _fingerprint(key)
    ).first()
    if count and isinstance(low, int) and high - low + 1 == count:
        whole = spark.range(low, high + 1).agg(_fingerprint("id")).first()[0]
        if whole == mark:
            return KeyLayout(count, low, high, nulls=nulls, dense=nulls == 0)
    plain = KeyLayout(count, low, high, nulls=nulls)
    if not with_cuts or count <= ROWS_PER_BUCKET:
        return plain
    parts = min(MAX_CUTS, -(-count // ROWS_PER_BUCKET))
    marks = [i / parts for i in range(1, parts)]
    quantiles = df.agg(F.percentile_approx(key, marks, max(1000, 4 * parts))).first()[0]
    times = Counter(float(q) for q in quantiles)
    shared = {value: n + 1 for value, n in times.items() if n > 1}
    return KeyLayout(count, low, high, sorted(times), nulls, shared=shared)


def with_bucket(df: DataFrame, key: str, layout: KeyLayout, tie: Column | None = None) -> DataFrame:
    """Add the bucket number of each row; it never decreases in the order of the rows.

    The number is never null. Were it nullable, a join on it would filter one of its two
    inputs, and inputs that differ cannot share one exchange. Rows without a key are in buckets
    below zero. ``tie`` cuts what shares a key.
    """
    tie = (tie_breakers(df)[0] if tie is None else tie) / F.lit(2.0**64) + F.lit(0.5)  # from 0 to 1
    null_parts = max(1, -(-layout.nulls // ROWS_PER_BUCKET))
    no_key = (F.least(F.floor(tie * null_parts), F.lit(null_parts - 1)) - null_parts).cast("int")
    if not layout.cuts:
        span = layout.high - layout.low + 1 if layout.count else 1
        place = F.floor((F.col(key) - (layout.low or 0)) / -(-span // layout.buckets)).cast("int")
        return df.withColumn(BUCKET, F.coalesce(place, no_key, F.lit(0)))
    edges = [float("-inf"), *layout.cuts, float("inf")]
    as_double = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    placed = Bucketizer(splits=edges, inputCol="_key", outputCol="_place").transform(as_double)
    # The keys of place n start at its edge; that edge itself may have buckets of its own.
    parts = [layout.shared.get(edge, 0) for edge in edges[:-1]]
    firsts = [n + sum(parts[:n]) for n in range(len(parts))]
    place = F.col("_place").cast("int")
    own, edge = F.get(F.lit(parts), place), F.get(F.lit(edges[:-1]), place)
    cut = F.least(F.floor(tie * own), own - 1)
    within = F.when(own == 0, F.lit(0)).when(F.col("_key") == edge, cut).otherwise(own)
    number = (F.get(F.lit(firsts), place) + within).cast("int")
    bucket = F.when(F.col(key).isNull(), no_key).otherwise(number)
    return placed.withColumn(BUCKET, F.coalesce(bucket, F.lit(0))).drop("_key", "_place")


def bucket_table(bucketed: DataFrame, key: str) -> DataFrame:
    """One row per non-empty bucket: first and last key, rows before it, and its
    neighbours' edge keys, wrapping round at the ends.

    The window below covers at most ``MAX_BUCKETS`` rows.
    """
    edges = bucketed.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_first"), F.max(key).alias("_last")
    )
    order = Window.orderBy(BUCKET)
    whole = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(
        BUCKET,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).cast("bigint").alias("_before"),
        F.coalesce(F.lead("_first").over(order), F.first("_first").over(whole)).alias("_next_first"),
        F.coalesce(F.lag("_last").over(order), F.last("_last").over(whole)).alias("_prev_last"),
    )



def with_position(df: DataFrame, key: str, layout: KeyLayout | None = None) -> DataFrame:
    """Add ``position``, the 0-based place of each row in order.

    Dense keys need arithmetic only. Otherwise rows are numbered inside their bucket and
    shifted by the rows of the buckets before it.
    """
    layout = layout or key_layout(df, key)
    if layout.dense:
        return df.withColumn("position", (F.col(key) - layout.low).cast("bigint"))
    bucketed = with_bucket(with_ties(df), key, layout, F.col(TIES[0]))
    before = bucket_table(bucketed.select(key, BUCKET), key).select(BUCKET, "_before")
    # Bounded: one row per bucket, see MAX_BUCKETS.
    joined = bucketed.join(F.broadcast(before), BUCKET)
    inside = Window.partitionBy(BUCKET).orderBy(F.col(key).asc_nulls_first(), *TIES)
    place = F.row_number().over(inside) - 1 + F.col("_before")
    return joined.withColumn("position", place.cast("bigint")).drop(BUCKET, "_before", *TIES)


@dataclass(frozen=True)
class Place:
    """The key at a position, and how many rows have a smaller key or none."""

    key: int | float | None
    before: int


def key_at(df: DataFrame, key: str, position: int) -> Place | None:
    """The key at a 0-based position in order, or None past the end.

    Reads only the key column: each round counts rows per bucket and narrows the search
    to one of them, until the rest is dense, has one key, or fits one bucket. Only
    per-bucket counts and the answer come back to the driver.
    """
    rest, left, passed = df.select(key), position, 0
    layout = key_layout(rest, key)
    if left < layout.nulls:
        return Place(None, 0)
    left, passed = left - layout.nulls, layout.nulls
    rest = rest.where(F.col(key).isNotNull())
    while True:
        if left >= layout.count:
            return None
        if layout.low == layout.high:
            return Place(layout.low, passed)
        if layout.dense:
            return Place(layout.low + left, passed + left)
        if not layout.cuts:
            order = Window.orderBy(key)
            numbered = rest.select(
                key, F.row_number().over(order).alias("_n"), F.rank().over(order).alias("_rank")
            )
            found = numbered.where(F.col("_n") == left + 1).first()
            return Place(found[0], passed + found["_rank"] - 1)
        edges = (
            with_bucket(rest, key, layout, F.lit(0))
            .groupBy(BUCKET)
            .agg(F.count(key), F.min(key), F.max(key))
            .orderBy(BUCKET)
            .collect()
        )
        for _, rows, first, last in edges:
            if left < rows:
                rest = rest.where(F.col(key).between(first, last))
                break
            left, passed = left - rows, passed + rows
        layout = key_layout(rest, key)
