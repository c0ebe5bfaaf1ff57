"""How far a scan is, as rows of a table.

A layer is read in micro-batches of some files each. Every batch is written to its target and observed on the
way; what was observed is one row of the progress table. Batch and row are written to
folders named after the batch, so a batch that runs again replaces both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OBSERVED = "batch BIGINT, rows BIGINT"


def scan_with_progress(rows: DataFrame, target: str, progress: str, state: str) -> StreamingQuery:
    """Write the rows of a stream of files to ``target`` and what each batch held to ``progress``, and stop
    when all that has arrived is read. A later run goes on where this one ended."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation(f"progress-{number}")
        observed = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        observed.write.mode("overwrite").parquet(f"{target}/batch={number}")
        row = spark.createDataFrame([(number, seen.get["rows"])], OBSERVED)
        row.coalesce(1).write.mode("overwrite").parquet(f"{progress}/part={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def progress_table(spark: SparkSession, progress: str, total: int) -> DataFrame:
    """``batch, rows, loaded, total, percent`` of every batch so far; one row for each, so a window over all is small."""
    rows = spark.read.schema(OBSERVED).parquet(progress)
    loaded = F.sum("rows").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(
        "batch",
        "rows",
        loaded.alias("loaded"),
        F.lit(total).cast("bigint").alias("total"),
        F.floor(100 * loaded / F.lit(max(1, total))).alias("percent"),
    )
