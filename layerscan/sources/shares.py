"""Shares of files: what one task reads, planned by tasks and kept as a table.

A source that plans on the driver holds every file and range of a tree there. Here tasks look at the
files and write *pieces* (a file and a range of it, with its bytes). Pieces are packed into
shares of like bytes by running sums, first inside each planning task's rows and then over
one row for each such task. The source is told the table and the number of shares; a
task reads the rows of its own share, or of a run of shares that follow each other where shares are too
small for a task each. Shares are written in groups of fixed size, so that finding one's rows means
reading one small file.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from layerscan.session import shared_folder
from layerscan.sources.files import filesystem

BYTES_PER_SHARE = 64 << 20
#: Shares smaller than this are read in runs, by at least so many tasks for each core.
BYTES_PER_TASK = BYTES_PER_SHARE
TASKS_PER_CORE = 4
#: What opening a file costs, in bytes; it bounds the pieces of a share.
OPENING = 256 << 10
SHARES_PER_GROUP = 256


@dataclass(frozen=True)
class Plan:
    """A folder with the rows of ``shares`` shares, and one with the first share of each task; without
    it, each share has its task."""

    folder: str
    shares: int
    tasks: str | None = None

    def options(self) -> dict[str, str]:
        return {"plan": self.folder, "shares": str(self.shares)} | ({"tasks": self.tasks} if self.tasks else {})


class Share(InputPartition):
    """The rows of the shares of a plan from ``first`` up to ``last``, which one task reads."""

    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


def planned(options: dict) -> Plan | None:
    """The plan that a source's options name."""
    return Plan(options["plan"], int(options["shares"]), options.get("tasks")) if options.get("plan") else None


def task_shares(plan: Plan) -> list[Share]:
    """What each task reads; one that reads nothing, if there are no shares."""
    firsts = range(max(1, plan.shares))
    if plan.tasks:
        fs, inner = filesystem(plan.tasks)
        firsts = sorted(pads.dataset(inner, filesystem=fs, format="parquet").to_table()["first"].to_pylist())
    return [Share(first, last) for first, last in zip(firsts, [*firsts[1:], max(1, plan.shares)], strict=True)]


def write_plan(pieces: DataFrame, bytes_per_share: int = BYTES_PER_SHARE) -> Plan:
    """Pack ``pieces`` (any columns, among them ``bytes``) into shares, in the order they come."""
    spark = pieces.sparkSession
    folder = shared_folder(spark, "plan")
    numbered = pieces.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    cost = F.coalesce("bytes", F.lit(0)) + OPENING
    whole = Observation()
    costed = numbered.observe(whole, F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("pieces"))
    costed.write.parquet(f"{folder}/pieces")
    cores = spark.sparkContext.defaultParallelism
    bytes_per_task = max(bytes_per_share, min(BYTES_PER_TASK, (whole.get["cost"] or 0) // (TASKS_PER_CORE * cores)))
    # The rows of a part are those that one planning task wrote.
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(cost).over(before), F.lit(0))
    written = spark.read.schema(numbered.schema).parquet(f"{folder}/pieces").withColumn("_begin", begin)
    packed = written.withColumn("_local", F.floor(F.col("_begin") / bytes_per_share))
    # A long piece passes over numbers; those in use follow each other without gaps.
    run = F.floor(F.min("_begin") / bytes_per_task)
    used = packed.groupBy("_part", "_local").agg(run.alias("_run"))
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy("_local")) - 1
    used = used.withColumn("_in_part", in_part)
    parts = used.groupBy("_part").agg(F.count(F.lit(1)).alias("_shares"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    parts = parts.withColumn("_first", F.coalesce(F.sum("_shares").over(earlier), F.lit(0)))
    share = (F.col("_first") + F.col("_in_part")).alias("share")
    numbers = used.join(parts, "_part").select("_part", "_local", "_run", share)
    placed = packed.join(numbers, ["_part", "_local"]).drop("_part", "_local", "_at", "_begin", "_run")
    seen = Observation()
    grouped = placed.withColumn("group", F.floor(F.col("share") / SHARES_PER_GROUP)).observe(
        seen, F.max("share").alias("last")
    )
    writers = max(1, min(cores, -(-whole.get["pieces"] // SHARES_PER_GROUP)))
    grouped.repartition(writers, "group").write.partitionBy("group").parquet(f"{folder}/shares")
    last = seen.get["last"]
    if last is None or bytes_per_task == bytes_per_share:
        return Plan(f"{folder}/shares", 0 if last is None else last + 1)
    # One row for each task: no more than the driver makes partitions of.
    firsts = numbers.groupBy("_part", "_run").agg(F.min("share").alias("first")).select("first")
    firsts.write.parquet(f"{folder}/tasks")
    return Plan(f"{folder}/shares", last + 1, f"{folder}/tasks")


def share_rows(plan: Plan, first: int, last: int | None = None) -> list[dict]:
    """The pieces of a share, or of those from ``first`` up to ``last``."""
    last, rows = min(first + 1 if last is None else last, plan.shares), []
    field = pads.field("share")
    for group in range(first // SHARES_PER_GROUP, -(-last // SHARES_PER_GROUP)):
        fs, inner = filesystem(f"{plan.folder}/group={group}")
        found = pads.dataset(inner, filesystem=fs, format="parquet").to_table(filter=(field >= first) & (field < last))
        rows += found.to_pylist()
    return rows


def cut_points(sizes, bytes_per_share: int):
    """Where to cut a run of items of these sizes, so that ranges hold about ``bytes_per_share``: the
    ranges' first items, and the bytes of each."""
    import numpy as np

    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.cumsum(sizes, dtype=np.int64)
    place = (total - sizes) // bytes_per_share
    firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return firsts, np.add.reduceat(np.asarray(sizes, np.int64), firsts)
