"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws a number from the hash of the key and of its own name,
exponential with its weight as the rate; the least draw wins. A child's chance is its share
of the weight. When a weight grows, only that child's draws get smaller, so rows move only
into subtrees whose weight grew, and when it shrinks, only out of those. A row reads as many
draws as there are children on its path, not as many as there are shards.

A new shard opens a region of its own by default (``with_shard``): no other weight
changes, so rows move only into the new shard. Put into a rack that has shards already, rows
that come from other racks may land on any of that rack's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in one part of a shard while slots are numbered.
PART_ROWS = 100_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """Shards 0 to ``shards - 1`` of weight one, filling racks and regions in turn."""
    racks = [n // per_rack for n in range(shards)]
    return [Shard(n, f"g{r // racks_per_region}", f"k{r}") for n, r in enumerate(racks)]


def with_shard(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    number = 1 + max(s.number for s in shards)
    return [*shards, Shard(number, f"new{number}", f"new{number}", weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of the key for one node: the smaller, the heavier."""
    # The hash's upper 53 bits, made a number above 0 and up to 1.
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11) + 1) / F.lit(float(1 << 53))
    return -F.log(even) / F.lit(weight)


def _winner(key: Column, children: dict[str, float], then) -> Column:
    """``then(child)`` of the child with the least draw; a tie goes to the first name."""
    if len(children) == 1:
        return then(next(iter(children)))
    draws = {c: _draw(key, c, w) for c, w in sorted(children.items())}
    least = F.least(*draws.values())
    first, *others = draws
    choice = then(first)
    for child in reversed([first, *others]):
        choice = F.when(draws[child] == least, then(child)).otherwise(choice)
    return choice


def _weights(shards: list[Shard], name) -> dict[str, float]:
    total: dict[str, float] = {}
    for shard in shards:
        total[name(shard)] = total.get(name(shard), 0.0) + shard.weight
    return total


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key. Null is a key like any other. Weights are positive.

    Plain columns: no shuffle, no Python, the same answer on every machine and in every run.
    """
    if not shards or any(s.weight <= 0 for s in shards):
        raise ValueError("shards need positive weights")
    by_number = {f"shard {s.number}": s.number for s in shards}

    def rack(name: str) -> Column:
        inside = [s for s in shards if s.rack == name]
        children = _weights(inside, lambda s: f"shard {s.number}")
        return _winner(key, children, lambda c: F.lit(by_number[c]))

    def region(name: str) -> Column:
        inside = [s for s in shards if s.region == name]
        return _winner(key, _weights(inside, lambda s: s.rack), rack)

    return _winner(key, _weights(shards, lambda s: s.region), region).cast("int")


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``: a number within the shard, gapless from 0.

    Rows are numbered in parts of a shard, by the hash of all their columns; parts are joined
    by their counts. Equal rows are counted first and expanded after, so a row that comes
    very often does not fill one task. Needs columns that can be grouped by; a column
    ``slot`` that was there is replaced.
    """
    from pyspark.sql import Window

    columns = [c for c in rows.columns if c != "slot"]
    rows = rows.select(*columns)
    parts = max(1, -(-rows.count() // PART_ROWS))
    counted = (
        rows.groupBy(*columns)
        .agg(F.count("*").alias("__rows"))
        .withColumn("__hash", F.xxhash64(*columns))
        .withColumn("__part", F.pmod("__hash", F.lit(parts)))
    )
    sizes = counted.groupBy(shard, "__part").agg(F.sum("__rows").alias("__size"))
    # One row for each part of a shard.
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(shard), "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    inside = (
        Window.partitionBy(shard, "__part")
        .orderBy("__hash", *columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("__at", F.coalesce(F.sum("__rows").over(inside), F.lit(0)))
    first = F.col("__start") + F.col("__at")
    return placed.join(starts, [shard, "__part"]).select(
        *columns, F.explode(F.sequence(first, first + F.col("__rows") - 1)).alias("slot")
    )


def assign(documents: DataFrame, shards: list[Shard], key: str = "doc_id") -> DataFrame:
    """``documents`` with ``shard``; a column of that name is replaced."""
    return documents.withColumn("shard", shard_of(F.col(key), shards))


def write(documents: DataFrame, folder: str, shards: list[Shard], key: str = "doc_id") -> None:
    """Write whole documents as Parquet, one folder for each shard, without a shuffle."""
    assign(documents, shards, key).write.partitionBy("shard").parquet(folder)
