"""Count and extent of layers whose files are rewritten and removed.

A stream of files reads each path once and never takes anything back. Here the state is a table
with a row for each file: its size and time of change, and its part of count and extent. A refresh
lists the folder in tasks, reads the files that are new or have changed, drops the parts of those that are gone
or were replaced, and writes the next version of the table. A version counts once its write is complete, so
a refresh that fails can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from layerscan.operators.profile import extent_of
from layerscan.session import shared_folder
from layerscan.sources.container import FOOTER_SCHEMA, extents_of, footers_of, layer_of
from layerscan.sources.discovery import list_tree, shown_files
from layerscan.sources.files import list_entries

BOX = ("xmin", "xmax", "ymin", "ymax")
STATE = "path STRING, length BIGINT, modified BIGINT, layer STRING, rows BIGINT, error STRING, " + ", ".join(
    f"{edge} DOUBLE" for edge in BOX
)


def _versions(table: str) -> list[int]:
    """Versions of a table that were written to the end."""
    found = [path.rsplit("version=", 1)[1] for path, _, folder, _ in list_entries(table) if folder and "version=" in path]
    return sorted(int(n) for n in found if list_entries(f"{table}/version={n}/_SUCCESS"))


def file_state(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The parts of all files, as the last refresh left them; none before the first."""
    versions = _versions(table) if version is None else [version]
    if not versions:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{table}/version={versions[-1]}")


def refresh(
    spark: SparkSession, folder: str, table: str, axes: dict[str, tuple[str, str]] | None = None
) -> dict[str, int]:
    """Bring the state of the Parquet layers in ``folder`` up to date; how many files were read, kept and dropped.

    ``axes`` names the x and y of layers without box columns.
    """
    versions = _versions(table)
    before = file_state(spark, table)
    listing = shared_folder(spark, "listing")
    files = shown_files(list_tree(spark, folder), folder).where(F.col("path").rlike(r"(?i)\.parquet$"))
    files.withColumn("layer", layer_of(F.col("path"), folder)).write.parquet(listing)
    files = spark.read.schema("path STRING, length BIGINT, modified BIGINT, layer STRING").parquet(listing)
    same = ["path", "length", "modified"]
    kept = before.join(files, same, "left_semi")
    changed = files.join(before, same, "left_anti")
    footers = shared_folder(spark, "footers")
    tasks = spark.sparkContext.defaultParallelism
    read, stay = Observation(), Observation()
    footers_of(changed.repartition(tasks, "path"), axes).observe(read, F.count(F.lit(1)).alias("n")).write.parquet(footers)
    written = spark.read.schema(FOOTER_SCHEMA).parquet(footers)
    boxes = extents_of(written, axes, by=("path",)).select("path", *[F.col("extent")[edge].alias(edge) for edge in BOX])
    parts = (
        written.select("path", F.coalesce("num_rows", F.lit(0)).alias("rows"), "error")
        .join(boxes, "path")
        .join(changed, "path")
    )
    columns = [field.split()[0] for field in STATE.split(", ")]
    number = versions[-1] + 1 if versions else 0
    kept = kept.select(columns).observe(stay, F.count(F.lit(1)).alias("n"))
    state = kept.unionByName(parts.select(columns))
    state.write.mode("overwrite").parquet(f"{table}/version={number}")
    counts = {"read": read.get["n"], "kept": stay.get["n"]}
    return {**counts, "dropped": before.count() - counts["kept"]}


def profile_of(state: DataFrame) -> DataFrame:
    """Count, files and extent per layer from the parts of its files."""
    return state.groupBy("layer").agg(
        F.sum("rows").alias("feature_count"),
        F.count(F.lit(1)).alias("files"),
        extent_of(*map(F.col, BOX)).alias("extent"),
        F.max("error").alias("error"),
    )


def follow(
    spark: SparkSession,
    folder: str,
    table: str,
    state: str,
    axes: dict[str, tuple[str, str]] | None = None,
    interval: str = "1 minute",
) -> StreamingQuery:
    """A query that refreshes the table at intervals until it is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(lambda _, __: refresh(spark, folder, table, axes) and None)
        .option("checkpointLocation", state)
        .trigger(processingTime=interval)
        .start()
    )
