"""Count and extent of a layer, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from layerscan.operators.profile import extent_of


def arriving_rows(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """Rows of the Parquet files in a folder, each file read once, as they arrive."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def running_profile(rows: DataFrame, layer: Column, x: Column, y: Column) -> DataFrame:
    """Count and extent per layer so far. State is one row per layer."""
    points = rows.select(layer.alias("layer"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    px, py = F.col("x"), F.col("y")
    return points.groupBy("layer").agg(
        F.count(F.lit(1)).alias("feature_count"), extent_of(px, px, py, py).alias("extent")
    )


def profile_stream(profile: DataFrame, table: str, state: str) -> StreamingQuery:
    """Run the profile over everything that has arrived and stop.

    Every micro-batch writes the whole profile to ``table/batch=<n>``; a repeated batch
    overwrites its own folder. ``state`` holds the query's checkpoint, so a later run
    goes on where this one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        profile.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def latest_profile(spark: SparkSession, table: str) -> DataFrame:
    """The profile as the last micro-batch left it."""
    batches = spark.read.parquet(table)
    last = batches.agg(F.max("batch")).first()[0]
    return batches.where(F.col("batch") == last).drop("batch")


def with_progress(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, plus a counter that is filled while they are read."""
    loaded = Observation(name)
    return df.observe(loaded, F.count(F.lit(1)).alias("loaded")), loaded
