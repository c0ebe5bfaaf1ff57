"""TIFFs built byte by byte, read back through the source."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerscan.operators.profile import array_bands, band_stats
from layerscan.plans.sample_files import tiff_bytes, tiff_file
from layerscan.sources.tiff import band_schema, raster_band_stats, raster_geometry, raster_headers


def grid(rows, columns, bands, dtype, seed=1):
    draw = np.random.default_rng(seed)
    return draw.integers(-500, 500, (rows, columns, bands)).astype(dtype)


def pixels_of(spark, path, **options):
    rows = spark.read.format("raster").options(**options).load(str(path)).collect()
    assert all(r.error is None for r in rows)
    return {(r.band, r.row, r.col): r.value for r in rows}


def expected_pixels(image):
    rows, columns, bands = image.shape
    return {(b + 1, r, c): float(image[r, c, b]) for r in range(rows) for c in range(columns) for b in range(bands)}


def check_stats(spark, path, image, nodata=None, **options):
    got = {r.band: r for r in raster_band_stats(spark, str(path)).collect()}
    for b in range(image.shape[2]):
        values = image[:, :, b].astype(float).ravel()
        values = values[values != nodata] if nodata is not None else values
        values = values[~np.isnan(values)]
        row = got[b + 1]
        assert row.valid_count == len(values)
        assert (row.min, row.max) == (values.min(), values.max())
        assert row.mean == pytest.approx(values.mean()) and row.stddev == pytest.approx(values.std())


def test_strips_with_nodata(spark, tmp_path):
    image = grid(37, 11, 2, "<i2")
    image[3, 4, 0] = image[30, 2, 1] = -9999
    path = tmp_path / "g.tif"
    path.write_bytes(tiff_bytes(image, 5, "-9999", (500000.0, 10.0, 4000000.0, -10.0), 32633))
    assert pixels_of(spark, path, bytesPerPartition="200") == expected_pixels(image)
    check_stats(spark, path, image, -9999)
    headers = raster_headers(spark, str(path))
    bands = [(r.driver, r.columns, r.rows, r.band_count, r.band, r.data_type, r.nodata, r.color_interp, r.block_size)
             for r in band_schema(headers).orderBy("band").collect()]
    assert bands == [("GTiff", 11, 37, 2, 1, "Int16", -9999.0, "Gray", "11x5"),
                     ("GTiff", 11, 37, 2, 2, "Int16", -9999.0, "Undefined", "11x5")]
    place = raster_geometry(headers).first()
    assert tuple(place.extent) == (500000.0, 500110.0, 3999630.0, 4000000.0)
    assert (place.cell_size_x, place.cell_size_y, place.crs, place.linear_unit, place.angular_unit) == (
        10.0, 10.0, "EPSG:32633 - WGS 84 / UTM zone 33N", "metre", None)


def test_shares_cover_every_block_once(spark, tmp_path):
    image = grid(64, 3, 1, "<u2")
    path = tmp_path / "s.tif"
    path.write_bytes(tiff_bytes(image.astype("<u2"), 2))
    df = spark.read.format("raster").option("bytesPerPartition", "50").load(str(path))
    assert df.rdd.getNumPartitions() > 8
    assert pixels_of(spark, path, bytesPerPartition="50") == expected_pixels(image.astype("<u2"))


def tiled(image, size, compress=True, predictor=1, separate=False, method=8):
    rows, columns, bands = image.shape
    blocks = []
    for band in range(bands) if separate else [slice(None)]:
        part = image[:, :, [band]] if separate else image
        for top in range(0, rows, size):
            for left in range(0, columns, size):
                block = np.zeros((size, size, part.shape[2]), image.dtype)
                cut = part[top : top + size, left : left + size]
                block[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 3:
                    width, depth, item = size, part.shape[2], image.dtype.itemsize
                    planes = block.astype(f">f{item}").view("u1").reshape(size, width * depth, item)
                    planes = planes.transpose(0, 2, 1).reshape(size, item * width, depth)
                    block = np.diff(planes, axis=1, prepend=np.zeros((size, 1, depth), "u1"))
                    raw = block.astype("u1").tobytes()
                    blocks.append(zlib.compress(raw) if compress else raw)
                    continue
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((size, 1, part.shape[2]), image.dtype))
                raw = block.astype(image.dtype).tobytes()
                blocks.append(zlib.compress(raw) if compress else raw)
    offsets = np.cumsum([8, *map(len, blocks)])[:-1].tolist()
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = [
        (256, "I", (columns,)), (257, "I", (rows,)), (258, "H", (image.dtype.itemsize * 8,) * bands),
        (259, "H", (method if compress else 1,)), (262, "H", (2 if bands >= 3 else 1,)), (277, "H", (bands,)),
        (284, "H", (2 if separate else 1,)), (317, "H", (predictor,)), (322, "I", (size,)), (323, "I", (size,)),
        (324, "I", tuple(offsets)), (325, "I", tuple(map(len, blocks))), (338, "H", (2,) if bands == 4 else (0,)),
        (339, "H", (kind,) * bands),
    ]
    return tiff_file(tags, blocks)


@pytest.mark.parametrize("separate", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("dtype", ["<i2", "<u1"])
def test_tiles(spark, tmp_path, dtype, predictor, separate):
    image = np.abs(grid(21, 35, 3, "<i2")).astype(dtype)
    path = tmp_path / "t.tif"
    path.write_bytes(tiled(image, 16, predictor=predictor, separate=separate))
    assert pixels_of(spark, path, bytesPerPartition="400") == expected_pixels(image)
    check_stats(spark, path, image)


def test_float_tiles_with_nan(spark, tmp_path):
    image = grid(20, 20, 1, "<f4") / 7
    image[5, 5, 0] = np.nan
    path = tmp_path / "f.tif"
    path.write_bytes(tiled(image.astype("<f4"), 16))
    check_stats(spark, path, image.astype("<f4"))
    rows = raster_headers(spark, str(path)).select("data_type", "block_x", "block_y", "error").collect()
    assert [tuple(r) for r in rows] == [("Float32", 16, 16, None)]


@pytest.mark.parametrize("dtype", ["<f4", "<f8"])
def test_float_predictor(spark, tmp_path, dtype):
    image = (grid(20, 19, 2, "<f8") / 7).astype(dtype)
    path = tmp_path / "p.tif"
    path.write_bytes(tiled(image, 16, predictor=3))
    assert pixels_of(spark, path) == expected_pixels(image)


def test_colour_roles(spark, tmp_path):
    path = tmp_path / "rgba.tif"
    path.write_bytes(tiled(np.abs(grid(4, 4, 4, "<i2")).astype("<u1"), 16))
    roles = [r.color_interp for r in raster_headers(spark, str(path)).orderBy("band").collect()]
    assert roles == ["Red", "Green", "Blue", "Alpha"]


def test_no_georeference_is_the_identity(spark, tmp_path):
    path = tmp_path / "plain.tif"
    path.write_bytes(tiff_bytes(grid(4, 6, 1, "<i2"), 4))
    row = raster_geometry(raster_headers(spark, str(path))).first()
    assert tuple(row.extent) == (0.0, 6.0, 4.0, 0.0)
    assert (row.crs, row.linear_unit) == (None, None)


def test_geographic_system(spark, tmp_path):
    path = tmp_path / "geo.tif"
    path.write_bytes(tiff_bytes(grid(2, 2, 1, "<i2"), 2, None, (10.0, 0.5, 50.0, -0.5), 4326))
    row = raster_geometry(raster_headers(spark, str(path))).first()
    assert (row.crs, row.linear_unit, row.angular_unit) == ("EPSG:4326 - WGS 84", None, "degree")


def big_tiff(image):
    """The same in the 64-bit layout, big-endian, one strip."""
    rows, columns, bands = image.shape
    data = image.astype(">i2").tobytes()
    tags = [(256, 4, columns), (257, 4, rows), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 16, 16), (277, 3, bands),
            (278, 4, rows), (279, 16, len(data)), (284, 3, 1), (339, 3, 2)]
    table = struct.pack(">Q", len(tags))
    for tag, kind, value in tags:
        code = {3: "H6x", 4: "I4x", 16: "Q"}[kind]
        table += struct.pack(f">HHQ{code}", tag, kind, 1, value)
    return struct.pack(">2sHHHQ", b"MM", 43, 8, 0, 16 + len(data)) + data + table + b"\0" * 8


def test_big_layout(spark, tmp_path):
    image = grid(9, 5, 1, ">i2")
    path = tmp_path / "big.tif"
    path.write_bytes(big_tiff(image))
    assert pixels_of(spark, path) == expected_pixels(image)


def test_undecodable_files_say_why(spark, tmp_path):
    (tmp_path / "lzw.tif").write_bytes(tiled(grid(4, 4, 1, "<i2"), 16, method=5))
    (tmp_path / "junk.tif").write_text("raster")
    (tmp_path / "photo.png").write_bytes(b"\x89PNG")
    (tmp_path / "good.tif").write_bytes(tiff_bytes(grid(4, 4, 1, "<i2"), 4))
    errors = {r.layer: r.error for r in raster_headers(spark, str(tmp_path)).collect()}
    assert errors["lzw"] == "Unsupported compression: LZW"
    assert "not a TIFF file" in errors["junk"] and "Could not open raster dataset" in errors["photo"]
    assert errors["good"] is None
    rows = spark.read.format("raster").load(str(tmp_path)).groupBy("path", "error").agg(F.count("value").alias("n"))
    got = {r.path.rsplit("/", 1)[1]: (r.n, r.error) for r in rows.collect()}
    assert got["lzw.tif"] == (0, "Unsupported compression: LZW") and got["good.tif"] == (16, None)
    stats = {r.path.rsplit("/", 1)[1]: r for r in raster_band_stats(spark, str(tmp_path)).collect()}
    assert sorted(stats) == ["good.tif", "junk.tif", "lzw.tif", "photo.png"]
    assert (stats["lzw.tif"].band, stats["lzw.tif"].max, stats["lzw.tif"].error) == (
        None, None, "Unsupported compression: LZW")
    assert stats["good.tif"].band == 1 and stats["good.tif"].error is None


def test_band_of_zeros_or_nodata_has_no_statistics(spark, tmp_path):
    image = np.zeros((6, 4, 2), "<i2")
    image[:, :, 1] = -1
    path = tmp_path / "blank.tif"
    path.write_bytes(tiff_bytes(image, 2, "-1"))
    rows = {r.band: (r.valid_count, r.min, r.max, r.mean, r.stddev)
            for r in raster_band_stats(spark, str(path)).collect()}
    assert rows == {1: (24, None, None, None, None), 2: (0, None, None, None, None)}


def test_array_bands(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, float("nan")],), ([5.0, 0.0],)], "v array<double>")
    rows = {r.band: tuple(r)[1:4] for r in band_stats(array_bands(df, "v"), ["band"], nodata=5).collect()}
    assert rows == {1: (2, 1.0, 3.0), 2: (2, 0.0, 2.0)}
