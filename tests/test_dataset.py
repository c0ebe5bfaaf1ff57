"""The questions of a dataset, end to end, on small file trees."""

import json

import numpy as np
import pytest

import layerscan
from layerscan.plans.sample_files import point_bytes, tiff_bytes
from layerscan.sources.discovery import discover, raster_layers
from tests.test_shapefile import COLUMNS, point_rows, save


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for stem, count in (("cities", 30), ("rivers", 4)):
        save(root / "vector", stem, 1, [point_bytes(i, 2 * i) for i in range(count)],
             (0, 0, count - 1, 2 * (count - 1)), COLUMNS, point_rows(count))
    (root / "imagery").mkdir()
    image = np.arange(24, dtype="<i2").reshape(6, 4, 1)
    for stem in ("ortho", "dem"):
        (root / "imagery" / f"{stem}.tif").write_bytes(tiff_bytes(image, 2, "-1", (10.0, 1.0, 20.0, -1.0), 4326))
    (root / "imagery" / "notes.txt").write_text("text")
    (root / "store.gdb").mkdir()
    (root / "store.gdb" / "a1.gdbtable").write_text("data")
    (root / "store.gdb" / "a2.gdbtable").write_text("more")
    (root / ".cache").mkdir()
    (root / ".cache" / "x.tif").write_text("hidden")
    (root / ".secret.tif").write_text("hidden")
    (root / "orphan.dbf").write_text("no shapefile")
    return root


def test_discovery(spark, tree):
    found = {r.path.split("/tree", 1)[1].split("/", 1)[1]: r for r in discover(spark, str(tree)).collect()}
    assert sorted(found) == ["imagery/dem.tif", "imagery/ortho.tif", "store.gdb", "vector/cities.shp", "vector/rivers.shp"]
    folder = tree / "vector"
    assert found["vector/cities.shp"].size_bytes == sum(f.stat().st_size for f in folder.glob("cities.*"))
    assert (found["store.gdb"].size, found["store.gdb"].type_label, found["store.gdb"].file_count) == (
        "8 B", "Geodatabase", 2)
    assert [r.layer for r in raster_layers(discover(spark, str(tree))).collect()] == ["dem", "ortho"]


def test_discovery_below_a_hidden_root(spark, tmp_path):
    root = tmp_path / ".data"
    (root / ".no").mkdir(parents=True)
    for name in ("a.tif", ".no/b.tif"):
        (root / name).write_text("x")
    assert [r.layer for r in discover(spark, str(root)).collect()] == ["a"]


def test_shapefile_questions(spark, tree):
    single = layerscan.open_dataset(spark, str(tree / "vector" / "cities.shp"))
    info = single.info().first()
    assert (info.type, info.layer, info.feature_count, info.geometry_type, info.crs, info.exists) == (
        "Shapefile", "cities", 30, "Point", "EPSG:4326 - WGS 84", True)
    assert [r.layer for r in single.layers().collect()] == ["cities"]
    rows = single.peek(3).collect()
    assert [(r.fid, r.id, r.geometry) for r in rows] == [(0, 0, "POINT"), (1, 1, "POINT"), (2, 2, "POINT")]
    assert single.peek(3).columns == ["fid", *[c[0] for c in COLUMNS], "geometry"]
    assert tuple(single.summary(3).first()) == ("cities", 30, 3)
    assert [r.fid for r in single.rows(skip=28).orderBy("fid").collect()] == [28, 29]
    assert sorted(r.fid for r in single.search("N2").collect()) == [2, *range(20, 30)]
    ring = {r.fid: (r.next_key, r.prev_key) for r in single.matches("n1").collect()}
    assert ring[1] == (10, 19) and ring[19] == (1, 18)


def test_folder_of_shapefiles(spark, tree):
    folder = layerscan.open_dataset(spark, str(tree / "vector") + "/")
    assert [r.layer for r in folder.layers().collect()] == ["cities", "rivers"]
    assert {r.layer for r in folder.schema().collect()} == {"cities"}
    assert {r.layer for r in folder.extent("rivers").collect()} == {"rivers"}
    assert tuple(folder.extent("rivers").first().extent) == (0.0, 3.0, 0.0, 6.0)
    assert folder.peek(layer="rivers").count() == 4
    fields = [(r.name, r.type, r.width, r.precision, r.nullable) for r in folder.schema("rivers").orderBy("ordinal").collect()]
    assert fields[0] == ("id", "Integer", 9, 0, True) and fields[2] == ("score", "Real", 12, 3, True)
    document = json.loads(folder.info_document().first()[0])
    assert document["type"] == "Shapefile" and document["layer_count"] == 2
    assert [entry["name"] for entry in document["layers"]] == ["cities", "rivers"]
    assert "\n  " in folder.info_document(pretty=True).first()[0]


def test_raster_questions(spark, tree):
    single = layerscan.open_dataset(spark, str(tree / "imagery" / "dem.tif"))
    info = single.info().first()
    assert (info.type, info.layer, info.columns, info.rows, info.crs) == ("Raster", "dem", 4, 6, "EPSG:4326 - WGS 84")
    assert tuple(info.extent) == (10.0, 14.0, 14.0, 20.0)
    band = info.bands[0]
    assert (band.band, band.data_type, band.nodata, band.min, band.max, band.mean) == (1, "Int16", -1.0, 0.0, 23.0, 11.5)
    assert single.schema().first().block_size == "4x2"
    assert "no rows to preview" in single.peek().first().error
    folder = layerscan.open_dataset(spark, str(tree / "imagery"))
    assert [r.layer for r in folder.layers().collect()] == ["dem", "ortho"]
    assert folder.pixels().count() == 48
    assert json.loads(single.info_document().first()[0])["bands"][0]["max"] == 23.0


def test_container_questions(spark, sf_dir):
    store = layerscan.open_dataset(spark, sf_dir, axes={"events": ("value", "user_id")})
    info = {r.layer: r for r in store.info().collect()}
    assert len(info) == 14 and info["region"].feature_count == 5
    assert info["events"].extent is not None and info["region"].extent is None
    assert info["region"].geometry_type == "None"
    assert store.schema("region").count() == 2
    assert [r.fid for r in store.peek(2, "orders").collect()] == [0, 1]
    assert store.first_layer() == "benchmark"
    document = json.loads(store.info_document().first()[0])
    assert document["layer_count"] == 14
    assert document["layers"][0]["extent"] is None and len(document["layers"][0]["fields"]) == 2


def test_container_with_geometry(spark, tree, tmp_path):
    shapes = spark.read.format("shapefile").load(str(tree / "vector" / "cities.shp"))
    target = tmp_path / "city.gdb"
    shapes.drop("layer", "geometry", "error").write.parquet(str(target / "cities.parquet"))
    spark.range(3).write.parquet(str(target / "plain.parquet"))
    store = layerscan.open_dataset(spark, str(target))
    got = {r.layer: (r.feature_count, r.geometry_type, r.extent and tuple(r.extent)) for r in store.info().collect()}
    assert got == {"cities": (30, "Point", (0.0, 29.0, 0.0, 58.0)), "plain": (3, "None", None)}
    assert [r.geometry for r in store.peek(2, "cities").collect()] == ["POINT", "POINT"]


@pytest.mark.parametrize("path", ["/does/not/exist.shp", "/does/not/exist.gdb", "/does/not/exist.tif"])
def test_missing_paths_answer_with_an_error(spark, path):
    nothing = layerscan.open_dataset(spark, path)
    info = nothing.info().first()
    assert (info.path, info.exists, info.size) == (path, False, "0 B")
    assert nothing.layers().count() == 0
    for answer in (nothing.schema(), nothing.extent(), nothing.peek()):
        assert answer.first().error


def test_unknown_layers_and_formats(spark, tree, sf_dir):
    folder = layerscan.open_dataset(spark, str(tree / "vector"))
    for answer in (folder.schema("lakes"), folder.extent("lakes"), folder.peek(layer="lakes"), folder.rows("lakes")):
        assert [r.error for r in answer.collect()] == ["Layer not found: lakes"]
    store = layerscan.open_dataset(spark, sf_dir)
    assert store.peek(layer="lakes").first().error == "Layer not found: lakes"
    other = layerscan.open_dataset(spark, "/some/file.csv")
    assert other.info().first().error.startswith("Unsupported input type: /some/file.csv")


def test_container_without_layers_of_ours(spark, tree):
    store = layerscan.open_dataset(spark, str(tree / "store.gdb"))
    info = store.info().first()
    assert (info.name, info.exists, info.size, info.layer_count, info.error) == (
        "store.gdb", True, "8 B", 0, "No layer here can be read")
    for answer in (store.schema(), store.extent("x"), store.peek()):
        assert answer.first().error == "No layer here can be read"


def test_container_with_odd_layers(spark, tmp_path):
    root = tmp_path / "odd.gdb"
    box = "xmin double, xmax double, ymin double, ymax double"
    spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)] * 3, box).write.parquet(f"{root}/my layer é+1.parquet")
    spark.createDataFrame([("a", 1.0, 1.0, 1.0)], box.replace("xmin double", "xmin string")).write.parquet(
        f"{root}/worded.parquet"
    )
    (root / "broken.parquet").write_bytes(b"PAR1 not really")
    rows = {r.layer: r for r in layerscan.open_dataset(spark, str(root)).catalog().collect()}
    assert sorted(rows) == ["broken", "my layer é+1", "worded"]
    named = rows["my layer é+1"]
    assert named.feature_count == 3 and tuple(named.extent) == (1.0, 2.0, 3.0, 4.0)
    assert rows["worded"].feature_count == 1 and rows["worded"].extent is None
    assert rows["broken"].error.startswith("Could not open layer file")


def test_sizes_count_files_of_any_name(spark, tmp_path):
    root = tmp_path / "store.gdb"
    (root / "_deep" / ".er").mkdir(parents=True)
    for name in ("a", "_b", ".c", "_deep/d", "_deep/.er/e"):
        (root / name).write_bytes(b"x" * 7)
    assert layerscan.open_dataset(spark, str(root)).size().first().size_bytes == 35
    (tmp_path / "_under.tif").write_bytes(b"x")
    found = {r.layer for r in discover(spark, str(tmp_path)).collect()}
    assert found == {"store", "_under"}


def test_size_of_one_shapefile_is_its_own(spark, tmp_path):
    for folder in (tmp_path, tmp_path / "deeper"):
        folder.mkdir(exist_ok=True)
        for name, size in (("a.shp", 100), ("a.dbf", 20), ("a.shp.xml", 3), ("b.shp", 50)):
            (folder / name).write_bytes(b"x" * size)
    assert layerscan.open_dataset(spark, str(tmp_path / "a.shp")).size().first().size_bytes == 123
