"""Plans made by tasks: listings, shares of like bytes, ranges that filters cut."""

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

from layerscan.plans.dataset import Container
from layerscan.plans.sample_files import dbf_bytes, point_bytes, polygon_bytes, shape_bytes, tiff_bytes
from layerscan.sources import container, discovery, files, shapefile, shares, tiff
from tests.test_raster import expected_pixels, grid, tiled
from tests.test_shapefile import save


def no_listing(*_):
    raise AssertionError("the driver listed a folder")


# --- listings ---------------------------------------------------------------------


def test_listing_goes_down_level_by_level(spark, tmp_path):
    wanted = set()
    for folder in ("", "a", "a/b", "a/b/c/d", "_x/.y", "empty"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for n in range(3 if folder != "empty" else 0):
            (tmp_path / folder / f"f {n}+%.txt").write_bytes(b"x" * n)
            wanted.add((os.path.join(folder, f"f {n}+%.txt"), n))
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    found = discovery.list_tree(spark, str(tmp_path)).collect()
    assert {(r.path.split(tmp_path.name + "/", 1)[1], r.length) for r in found} == wanted
    assert discovery.list_tree(spark, f"{tmp_path}/a/f 1+%.txt").collect()[0].length == 1
    assert discovery.list_tree(spark, f"{tmp_path}/nowhere").count() == 0


def test_hidden_names_count_only_below_the_root(spark, tmp_path):
    root = tmp_path / "_root"
    (root / ".no").mkdir(parents=True)
    for name in ("a.tif", "_b.tif", ".no/c.tif"):
        (root / name).write_text("x")
    shown = discovery.shown_files(discovery.list_tree(spark, str(root)), str(root))
    assert [r.path.rsplit("/", 1)[1] for r in shown.collect()] == ["a.tif"]
    single = discovery.list_tree(spark, str(root / "_b.tif"))
    assert discovery.shown_files(single, str(root / "_b.tif")).count() == 1


# --- shares -----------------------------------------------------------------------


def test_every_piece_is_in_one_share_of_like_bytes(spark):
    pieces = spark.range(0, 3000, 1, 7).select("id", (F.col("id") % 11 * 100_000).alias("bytes"))
    plan = shares.write_plan(pieces, 8 << 20)
    rows = [[(r["id"], r["bytes"]) for r in shares.share_rows(plan, n)] for n in range(plan.shares)]
    assert sorted(i for share in rows for i, _ in share) == list(range(3000))
    costs = [sum(size + shares.OPENING for _, size in share) for share in rows]
    assert all(costs) and max(costs) <= (8 << 20) + 1_000_000 + shares.OPENING
    assert plan.shares < 1.2 * sum(costs) / (8 << 20) + 7
    assert shares.share_rows(plan, plan.shares) == []


def test_tasks_read_runs_of_small_shares(spark):
    pieces = spark.range(0, 3000, 1, 7).select("id", F.when(F.col("id") == 2000, 90 << 20).otherwise(1000).alias("bytes"))
    plan = shares.write_plan(pieces, 1000)
    assert plan.shares == 3000
    tasks = shares.task_shares(plan)
    cost, cores = 3000 * (1000 + shares.OPENING) + (90 << 20), spark.sparkContext.defaultParallelism
    assert len(tasks) <= cost // shares.BYTES_PER_TASK + shares.TASKS_PER_CORE * cores + 7
    rows = [shares.share_rows(plan, t.first, t.last) for t in tasks]
    assert sorted(r["id"] for task in rows for r in task) == list(range(3000))
    costs = [sum(r["bytes"] + shares.OPENING for r in task if r["id"] != 2000) for task in rows]
    assert all(rows) and max(costs) <= shares.BYTES_PER_TASK + shares.OPENING + 1000
    wide = shares.write_plan(pieces)
    assert [(t.first, t.last) for t in shares.task_shares(wide)] == [(n, n + 1) for n in range(wide.shares)]


def test_no_pieces(spark):
    plan = shares.write_plan(spark.range(0).select("id", F.lit(1).alias("bytes")))
    assert plan.shares == 0 and shares.share_rows(plan, 0) == []


def test_cut_points():
    sizes = np.array([10, 10, 500, 1, 1, 90, 10])
    firsts, total = shares.cut_points(sizes, 100)
    assert firsts[0] == 0 and total.sum() == sizes.sum() and total.max() <= 600
    assert [len(x) for x in shares.cut_points(np.zeros(0, int), 100)] == [0, 0]


# --- rasters ----------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", "deflate", "predictor", "float"])
def test_one_strip_gives_several_shares(spark, tmp_path, kind):
    image = grid(200, 30, 2, "<f4" if kind == "float" else "<i2")
    path = tmp_path / "one.tif"
    if kind == "plain":
        path.write_bytes(tiff_bytes(image, 200, "-9"))
    else:
        path.write_bytes(tiled(image, 208, predictor={"deflate": 1, "predictor": 2, "float": 3}[kind]))
    plan = tiff.raster_plan(spark, str(path), bytes_per_share=2000, segment_bytes=1000)
    assert plan.shares > 5 if kind == "plain" else plan.shares == 1  # a compressed block starts at its start
    rows = tiff.raster_pixels(spark, str(path), plan).collect()
    assert {(r.band, r.row, r.col): r.value for r in rows} == expected_pixels(image) and len(rows) == image.size
    whole, cut = (
        {r.band: r for r in tiff.raster_band_stats(spark, str(path), ["band"], p).collect()} for p in (None, plan)
    )
    for band in (1, 2):
        assert cut[band].valid_count == whole[band].valid_count
        assert (cut[band].min, cut[band].max) == (whole[band].min, whole[band].max)
        assert cut[band].stddev == pytest.approx(whole[band].stddev)


def test_small_shares_of_a_raster_need_few_tasks(spark, tmp_path):
    image = grid(3000, 10, 2, "<i2")
    (tmp_path / "one.tif").write_bytes(tiff_bytes(image, 3000, "-9"))
    plan = tiff.raster_plan(spark, str(tmp_path), bytes_per_share=400, segment_bytes=200)
    assert plan.shares == 300
    pixels = tiff.raster_pixels(spark, str(tmp_path), plan)
    most = 4 * spark.sparkContext.defaultParallelism + 1
    assert pixels.rdd.getNumPartitions() <= most
    assert {(r.band, r.row, r.col): r.value for r in pixels.collect()} == expected_pixels(image)
    assert pixels.count() == image.size
    whole, cut = (
        {r.band: r for r in tiff.raster_band_stats(spark, str(tmp_path), ["band"], p).collect()} for p in (None, plan)
    )
    for band in (1, 2):
        assert cut[band][1:4] == whole[band][1:4] and cut[band].stddev == pytest.approx(whole[band].stddev)


def test_a_block_is_inflated_in_parts():
    data = np.arange(1 << 18, dtype="<i4").tobytes()
    packed = zlib.compress(data)
    wanted = [4096] * (len(data) // 4096)

    class Handle:
        at = most = 0

        def seek(self, at):
            self.at = at

        def read(self, size):
            Handle.most = max(Handle.most, size)
            found = packed[self.at - 8 : self.at - 8 + size]
            self.at += len(found)
            return found

    parts = list(tiff._inflated(Handle(), 8, len(packed), wanted))
    assert b"".join(parts) == data and max(map(len, parts)) == 4096
    assert Handle.most <= tiff.INFLATE_BYTES
    with pytest.raises(ValueError, match="ends early"):
        list(tiff._inflated(Handle(), 8, len(packed) // 2, wanted))


def test_missing_and_foreign_rasters_say_so(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / "b.tif").write_bytes(tiff_bytes(grid(4, 4, 1, "<i2"), 4))
    found = {r.path.rsplit("/", 1)[1]: r.error for r in tiff.raster_pixels(spark, str(tmp_path)).collect()}
    assert found["b.tif"] is None and found["a.jpg"]
    missing = f"{tmp_path}/none.tif"
    assert [r.error for r in tiff.raster_pixels(spark, missing).collect()] == [tiff.MISSING]
    direct = spark.read.format("raster").load(missing).collect()
    assert [(r.path, r.error) for r in direct] == [(missing, tiff.MISSING)]


# --- shapefiles -------------------------------------------------------------------


def rings(points):
    along = [(float(i), 1.0) for i in range(points)]
    return [[*along, (points - 1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]]


@pytest.fixture(scope="module")
def unequal(tmp_path_factory):
    """A hundred polygons, the last of which have most of the points."""
    folder = tmp_path_factory.mktemp("unequal")
    sizes = [3 if n < 90 else 4000 for n in range(100)]
    contents, boxes = zip(*[polygon_bytes(rings(n)) for n in sizes], strict=True)
    save(folder, "polys", 5, list(contents), (0, 0, 4000, 1), [("id", "N", 9, 0)], [[str(n)] for n in range(100)])
    return str(folder)


def test_ranges_have_like_bytes(spark, unequal):
    found = shapefile.shapefile_plan(spark, unequal, bytes_per_share=1 << 30, bytes_per_range=100_000)
    pieces = sorted((r["low"], r["high"], r["bytes"]) for r in shares.share_rows(found.plan, 0))
    assert [low for low, _, _ in pieces[1:]] == [high for _, high, _ in pieces[:-1]] and pieces[-1][1] == 100
    assert pieces[0][1] > 90 and len(pieces) >= 6
    assert max(size for _, _, size in pieces) < 100_000 + 70_000
    rows = shapefile.read_shapefiles(spark, found, ["fid", "id", "geometry", "xmax"]).collect()
    assert sorted((r.fid, r.id) for r in rows) == [(n, n) for n in range(100)]
    assert {r.geometry for r in rows} == {"POLYGON"} and max(r.xmax for r in rows) == 3999


def test_index_read_in_chunks_gives_the_same_ranges(unequal, monkeypatch):
    row = {"layer": "polys", "shp": f"{unequal}/polys.shp", "shx": f"{unequal}/polys.shx", "dbf": None, "cpg": None}
    whole = shapefile._cut(row, 50_000)
    monkeypatch.setattr(shapefile, "ENTRIES_AT_ONCE", 7)
    assert shapefile._cut(row, 50_000) == whole


def test_the_driver_lists_nothing_and_fid_filters_cut(spark, unequal, monkeypatch):
    found = shapefile.shapefile_plan(spark, unequal, bytes_per_share=100_000, bytes_per_range=50_000)
    monkeypatch.setattr(shapefile, "list_sizes", no_listing)
    reader = shapefile.ShapefileReader(found.schema, found.plan.options())
    everything = [p for share in reader.partitions() for p in reader.pieces(share)]
    assert len(reader.partitions()) == found.plan.shares > 1
    assert list(reader.pushFilters([GreaterThanOrEqual(("fid",), 97)])) == []
    cut = [p for share in reader.partitions() for p in reader.pieces(share)]
    assert len(cut) < len(everything) / 2 and min(p.low for p in cut) == 97
    df = shapefile.read_shapefiles(spark, found, ["fid"])
    assert sorted(r.fid for r in df.where("fid >= 97").collect()) == [97, 98, 99]


def test_box_filters_leave_out_ranges(spark, tmp_path):
    contents = [point_bytes(None if n % 50 == 3 else float(n), -float(n)) for n in range(1000)]
    save(tmp_path, "p", 1, contents, (0, -999, 999, 0), [("id", "N", 9, 0)], [[str(n)] for n in range(1000)])
    plain = shapefile.shapefile_plan(spark, str(tmp_path), bytes_per_range=2000)
    zoned = shapefile.with_zones(spark, plain)
    filters = [GreaterThanOrEqual(("xmax",), 100.0), LessThanOrEqual(("xmin",), 140.0)]
    counts = []
    for found in (plain, zoned):
        reader = shapefile.ShapefileReader(found.schema, found.plan.options())
        assert list(reader.pushFilters(filters)) == filters
        counts.append(sum(len(reader.pieces(share)) for share in reader.partitions()))
        df = shapefile.read_shapefiles(spark, found, ["fid", "xmin", "xmax"]).where("xmax >= 100 AND xmin <= 140")
        assert sorted(r.fid for r in df.collect()) == [n for n in range(100, 141) if n % 50 != 3]
    assert counts[1] <= 3 < counts[0]


def test_small_shares_of_shapefiles_need_few_tasks(spark, tmp_path):
    contents = [point_bytes(float(n), -float(n)) for n in range(1000)]
    save(tmp_path, "p", 1, contents, (0, -999, 999, 0), [("id", "N", 9, 0)], [[str(n)] for n in range(1000)])
    plain = shapefile.shapefile_plan(spark, str(tmp_path), bytes_per_share=1, bytes_per_range=400)
    most = 4 * spark.sparkContext.defaultParallelism + 1
    for found in (plain, shapefile.with_zones(spark, plain)):
        df = shapefile.read_shapefiles(spark, found, ["fid", "xmin"])
        assert found.plan.shares > 2 * most and df.rdd.getNumPartitions() <= most
        assert sorted(r.fid for r in df.collect()) == list(range(1000))
        assert sorted(r.fid for r in df.where("xmin >= 990").collect()) == list(range(990, 1000))


def test_sidecars_of_any_spelling(spark, tmp_path):
    save(tmp_path, "up", 1, [point_bytes(1.0, 2.0)], (1, 2, 1, 2), [("id", "N", 9, 0)], [["5"]], upper=True)
    save(tmp_path, "Low", 1, [point_bytes(3.0, 4.0)], (3, 4, 3, 4), [("ID", "N", 12, 3)], [["6.5"]])
    os.rename(tmp_path / "Low.dbf", tmp_path / "low.DBF")
    (tmp_path / "bad.shp").write_bytes(struct.pack(">i", 9994))
    rows = {r.layer: r for r in shapefile.open_shapefiles(spark, str(tmp_path)).collect()}
    assert (rows["up"].ID if "ID" in rows["up"] else rows["up"].id) == 5.0 and rows["Low"].xmin == 3.0
    assert rows["bad"].error == f"Could not open shapefile: {shapefile.NO_INDEX}"
    one = shapefile.open_shapefiles(spark, str(tmp_path / "Low.shp"))
    assert [r.layer for r in one.collect()] == ["Low"]


def test_what_does_not_fit_is_an_error():
    with pytest.raises(ValueError, match="more than 3 bytes"):
        dbf_bytes([("a", "C", 3, 0)], [["four"]])
    with pytest.raises(ValueError, match="10 bytes"):
        dbf_bytes([("a_long_name_", "C", 3, 0)], [])
    assert shape_bytes(1, [], (0, 0, 0, 0))


# --- containers -------------------------------------------------------------------


@pytest.fixture
def layers(tmp_path):
    box = {"xmin": [1.0, 5.0], "xmax": [2.0, 6.0], "ymin": [-1.0, None], "ymax": [0.0, None]}
    pq.write_table(pa.table(box), tmp_path / "known.parquet")
    pq.write_table(pa.table(box), tmp_path / "bare.parquet", write_statistics=False)
    shape = struct.pack("<BI2d", 1, 1, 1.0, 2.0)
    pq.write_table(pa.table({"id": [1, 2], "geometry_wkb": [shape, None]}), tmp_path / "shapes.parquet")
    pq.write_table(pa.table({"id": [7, 9], "v": [0.5, float("nan")]}), tmp_path / "axes.parquet")
    pq.write_table(pa.table({"id": pa.array([], pa.int64())}), tmp_path / "empty.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1")
    return str(tmp_path)


def test_extents_come_from_footers(spark, layers, monkeypatch):
    found = {r.layer: r for r in Container(spark, layers, axes={"axes": ("id", "v")}).catalog().collect()}
    assert tuple(found["known"].extent) == tuple(found["bare"].extent) == (1.0, 6.0, -1.0, 0.0)
    assert tuple(found["axes"].extent) == (7.0, 9.0, 0.5, 0.5)
    assert (found["shapes"].geometry_type, found["shapes"].extent) == ("Point", None)
    assert (found["empty"].feature_count, found["empty"].extent) == (0, None) and found["broken"].error
    footers = container.written_footers(spark, layers)
    edges = {r.layer: r.edges for r in footers.collect()}
    assert (edges["known"], edges["bare"], edges["shapes"], edges["empty"]) == ("known", "scan", "none", "none")


def test_pages_are_read_only_without_statistics(layers, monkeypatch):
    row = {"path": f"{layers}/known.parquet", "length": 1, "layer": "known"}
    batch = pa.RecordBatch.from_pylist([row])
    monkeypatch.setattr(pq.ParquetFile, "iter_batches", no_listing)
    (out,) = container._footer_rows({})(iter([batch]))
    assert out.to_pylist()[0]["edges"] == "known"


def test_files_are_listed_by_folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("x")
    assert [(p.rsplit("/", 1)[1], folder) for p, _, folder, _ in files.list_entries(str(tmp_path))] == [("a", True)]
