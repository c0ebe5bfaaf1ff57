import time
import pytest
from pyspark.sql import functions as F

from layerscan.session import shared_folder
from layerscan.streaming.profile import (
    arriving_rows,
    latest_profile,
    profile_stream,
    running_profile,
    with_progress,
)


def test_profile_goes_on_where_it_ended(spark, tmp_path):
    incoming, table, state = str(tmp_path / "in"), str(tmp_path / "profile"), str(tmp_path / "state")

    def arrive(low, high):
        rows = spark.range(low, high).select((F.col("id") * 2.0).alias("x"), (-F.col("id")).cast("double").alias("y"))
        rows.withColumn("kind", F.when(F.col("x") % 4 == 0, "even").otherwise("odd")).coalesce(2).write.mode(
            "append").parquet(incoming)

    def run():
        schema = spark.read.parquet(incoming).schema
        rows = arriving_rows(spark, incoming, schema, files_per_batch=1)
        profile_stream(running_profile(rows, F.col("kind"), F.col("x"), F.col("y")), table, state).awaitTermination()
        return {r.layer: (r.feature_count, tuple(r.extent)) for r in latest_profile(spark, table).collect()}

    arrive(0, 10)
    assert run() == {"even": (5, (0.0, 16.0, -8.0, 0.0)), "odd": (5, (2.0, 18.0, -9.0, -1.0))}
    arrive(10, 20)
    assert run() == {"even": (10, (0.0, 36.0, -18.0, 0.0)), "odd": (10, (2.0, 38.0, -19.0, -1.0))}


def test_progress_counts_what_was_read(spark):
    rows, loaded = with_progress(spark.range(1234), "scan")
    rows.write.format("noop").mode("overwrite").save()
    assert loaded.get == {"loaded": 1234}


def test_shared_folder_lies_in_the_checkpoint_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(configured or spark.sparkContext.getCheckpointDir())
    assert first != second


@pytest.mark.parametrize("rows", [0, 1])
def test_profile_of_little(spark, rows):
    df = spark.range(rows).select(F.lit("a").alias("layer"), F.lit(1.0).alias("x"), F.lit(None).cast("double").alias("y"))
    got = running_profile(df, F.col("layer"), F.col("x"), F.col("y")).collect()
    assert [tuple(r) for r in got] == [("a", 1, None)][:rows]


def saved(folder, name, xs):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"id": xs, "v": [float(x) * 2 for x in xs]}), folder / f"{name}.parquet")


def test_rewritten_and_removed_files(spark, tmp_path):
    from layerscan.streaming.files import file_state, profile_of, refresh

    folder, state = tmp_path / "layers", f"{tmp_path}/state"
    axes = {"roads": ("id", "v"), "cities": ("v", "id")}
    for name, xs in (("a", [1, 2]), ("b", [5, 9, 7]), ("c", [100])):
        saved(folder / "roads", name, xs)
    saved(folder, "cities", [3, 4])

    def profile():
        rows = profile_of(file_state(spark, state)).collect()
        return {r.layer: (r.feature_count, r.files, r.extent and tuple(r.extent)) for r in rows}

    assert profile() == {}
    assert refresh(spark, str(folder), state, axes) == {"read": 4, "kept": 0, "dropped": 0}
    assert profile() == {"roads": (6, 3, (1, 100, 2, 200)), "cities": (2, 1, (6, 8, 3, 4))}
    assert refresh(spark, str(folder), state, axes) == {"read": 0, "kept": 4, "dropped": 0}
    saved(folder / "roads", "b", [50, 60, 70, 80])
    (folder / "roads" / "c.parquet").unlink()
    assert refresh(spark, str(folder), state, axes) == {"read": 1, "kept": 2, "dropped": 2}
    assert profile() == {"roads": (6, 2, (1, 80, 2, 160)), "cities": (2, 1, (6, 8, 3, 4))}
    (folder / "roads" / "a.parquet").write_bytes(b"broken")
    (folder / "cities.parquet").unlink()
    refresh(spark, str(folder), state, axes)
    assert profile() == {"roads": (4, 2, (50, 80, 100, 160))}
    # A version that was not finished does not count.
    (tmp_path / "state" / "version=4").mkdir()
    assert profile() == {"roads": (4, 2, (50, 80, 100, 160))}
    assert refresh(spark, str(folder), state, axes)["kept"] == 2


def test_following_a_folder(spark, tmp_path):
    from layerscan.streaming.files import file_state, follow

    saved(tmp_path / "layers", "roads", [1, 2])
    query = follow(spark, f"{tmp_path}/layers", f"{tmp_path}/state", f"{tmp_path}/log", {"roads": ("id", "v")}, "1 second")
    try:
        end = time.time() + 60
        while not file_state(spark, f"{tmp_path}/state").count() and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.rows for r in file_state(spark, f"{tmp_path}/state").collect()] == [2]


def test_progress_is_a_table(spark, tmp_path):
    from layerscan.streaming.progress import progress_table, scan_with_progress

    def run():
        rows = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        scan_with_progress(rows, f"{tmp_path}/out", f"{tmp_path}/progress", f"{tmp_path}/state").awaitTermination()
        return [tuple(r) for r in progress_table(spark, f"{tmp_path}/progress", 8).orderBy("batch").collect()]

    for name in "abc":
        saved(tmp_path / "in", name, [1, 2])
    assert run() == [(0, 2, 2, 8, 25), (1, 2, 4, 8, 50), (2, 2, 6, 8, 75)]
    saved(tmp_path / "in", "d", [8, 9])
    assert run()[-1] == (3, 2, 8, 8, 100)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
