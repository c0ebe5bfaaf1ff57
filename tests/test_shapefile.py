"""Shapefiles built byte by byte, read back through the source."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from layerscan import functions as fn
from layerscan.plans.sample_files import WGS84_WKT, dbf_bytes, point_bytes, shape_bytes
from layerscan.sources.shapefile import shapefile_headers

COLUMNS = [("id", "N", 9, 0), ("name", "C", 12, 0), ("score", "N", 12, 3), ("day", "D", 8, 0), ("ok", "L", 1, 0),
           ("big", "N", 18, 0)]


def save(folder, stem, code, contents, box, columns=COLUMNS, rows=None, deleted=(), prj=WGS84_WKT, upper=False):
    folder.mkdir(parents=True, exist_ok=True)
    shp, shx = shape_bytes(code, contents, box)
    parts = {"shp": shp, "shx": shx, "dbf": dbf_bytes(columns, rows or [], deleted)}
    if prj:
        parts["prj"] = prj.encode()
    for ending, data in parts.items():
        (folder / f"{stem}.{ending.upper() if upper else ending}").write_bytes(data)


def point_rows(count):
    return [
        [str(i), f"n{i}", None if i % 4 == 0 else f"{i / 8:.3f}", f"2024{1 + i % 12:02d}15", "TF?"[i % 3], str(10**12 + i)]
        for i in range(count)
    ]


@pytest.fixture(scope="module")
def points(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shapes")
    contents = [point_bytes(None if i == 7 else i * 1.5, -float(i)) for i in range(1000)]
    save(folder, "points", 1, contents, (0, -999, 1498.5, 0), rows=point_rows(1000), deleted={500})
    return str(folder / "points.shp")


def test_points(spark, points):
    df = spark.read.format("shapefile").option("rowsPerPartition", 130).load(points)
    assert df.rdd.getNumPartitions() == 8
    rows = {r.fid: r for r in df.collect()}
    assert sorted(rows) == [i for i in range(1000) if i != 500]
    third = rows[3]
    assert (third.layer, third.id, third.name, third.score, third.day, third.ok, third.big) == (
        "points", 3, "n3", 0.375, datetime.date(2024, 4, 15), True, 10**12 + 3)
    assert (third.geometry, third.xmin, third.xmax, third.ymin, third.ymax) == ("POINT", 4.5, 4.5, -3.0, -3.0)
    assert bytes(third.geometry_wkb) == struct.pack("<BI2d", 1, 1, 4.5, -3.0)
    assert rows[4].score is None and rows[4].ok is False and rows[5].ok is None
    assert (rows[7].geometry, rows[7].geometry_wkb, rows[7].xmin) == (None, None, None)


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ("fid < 10", range(10)),
        ("fid >= 990", range(990, 1000)),
        ("fid > 995 AND fid <= 998", [996, 997, 998]),
        ("fid = 42", [42]),
        ("fid = 42 AND name = 'n42'", [42]),
        ("fid > 5000", []),
    ],
)
def test_fid_filters(spark, points, condition, expected):
    df = spark.read.format("shapefile").load(points).where(condition)
    assert sorted(r.fid for r in df.select("fid").collect()) == list(expected)


def test_fid_filter_cuts_partitions(spark, points):
    df = spark.read.format("shapefile").option("rowsPerPartition", 100).load(points)
    assert df.rdd.getNumPartitions() == 10
    assert df.where("fid >= 850").rdd.getNumPartitions() == 2


def test_columns_option(spark, points):
    df = spark.read.format("shapefile").option("columns", "fid,name").load(points)
    assert df.columns == ["fid", "name"]
    assert df.count() == 999


def test_headers(spark, points):
    row = shapefile_headers(spark, points).first()
    assert (row.layer, row.geometry_type, row.feature_count, row.crs, row.field_count, row.error) == (
        "points", "Point", 1000, "EPSG:4326 - WGS 84", 6, None)
    assert tuple(row.extent) == (0.0, 1498.5, -999.0, 0.0)
    assert [(f.name, f.type, f.width, f.precision) for f in row.fields] == [
        ("id", "Integer", 9, 0), ("name", "String", 12, 0), ("score", "Real", 12, 3), ("day", "Date", 8, 0),
        ("ok", "Integer", 1, 0), ("big", "Integer64", 18, 0)]


def poly(code, rings, z=None):
    flat = [p for r in rings for p in r]
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    starts, at = [], 0
    for r in rings:
        starts.append(at)
        at += len(r)
    out = struct.pack("<i4d2i", code, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat))
    out += struct.pack(f"<{len(starts)}i", *starts)
    out += b"".join(struct.pack("<2d", *p) for p in flat)
    if z is not None:
        out += struct.pack("<2d", min(z), max(z)) + struct.pack(f"<{len(z)}d", *z)
    return out


def square(x, y, size, clockwise=True):
    ring = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]
    return ring if clockwise else ring[::-1]


def read_wkb(data, at=0):
    """Nested tuples of a little-endian WKB value, and where it ends."""
    _, code = struct.unpack_from("<BI", data, at)
    at += 5
    size = 3 if code // 1000 else 2

    def run(at):
        (n,) = struct.unpack_from("<I", data, at)
        return [struct.unpack_from(f"<{size}d", data, at + 4 + 8 * size * i) for i in range(n)], at + 4 + 8 * size * n

    if code % 1000 == 1:
        return struct.unpack_from(f"<{size}d", data, at), at + 8 * size
    if code % 1000 == 2:
        return run(at)
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    items = []
    for _ in range(n):
        item, at = run(at) if code % 1000 == 3 else read_wkb(data, at)
        items.append(item)
    return items, at


def decoded(row):
    value, end = read_wkb(bytes(row.geometry_wkb))
    assert end == len(row.geometry_wkb)
    return value


def read_all(spark, path):
    df = spark.read.format("shapefile").load(str(path))
    named = df.withColumn("from_wkb", fn.geometry_name(F.col("geometry_wkb")))
    rows = {(r.layer, r.fid): r for r in named.collect()}
    assert all(r.geometry == r.from_wkb for r in rows.values() if r.error is None)
    return rows


def test_polygons(spark, tmp_path):
    outer, hole, other = square(0, 0, 10), square(2, 2, 3, clockwise=False), square(20, 20, 5)
    contents = [poly(5, [outer]), poly(5, [outer, hole]), poly(5, [other, hole, outer]), poly(5, [hole])]
    save(tmp_path, "polys", 5, contents, (0, 0, 25, 25), [("id", "N", 4, 0)], [[str(i)] for i in range(4)])
    rows = read_all(spark, tmp_path)
    assert [rows["polys", i].geometry for i in range(4)] == ["POLYGON", "POLYGON", "MULTIPOLYGON", "POLYGON"]
    assert decoded(rows["polys", 1]) == [outer, hole]
    assert decoded(rows["polys", 2]) == [[other], [outer, hole]]
    assert (rows["polys", 2].xmin, rows["polys", 2].xmax) == (0.0, 25.0)


def test_lines_multipoints_and_z(spark, tmp_path):
    a, b = [(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0), (7.0, 5.0)]
    save(tmp_path, "lines", 3, [poly(3, [a]), poly(3, [a, b])], (0, 0, 7, 6), rows=point_rows(2))
    save(tmp_path, "linesz", 13, [poly(13, [a], z=[3.0, 4.0])], (0, 0, 1, 1), rows=point_rows(1))
    multi = struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + struct.pack("<4d", 0, 0, 1, 1)
    save(tmp_path, "multi", 8, [multi], (0, 0, 1, 1), rows=point_rows(1))
    save(tmp_path, "pointz", 11, [struct.pack("<i4d", 11, 1, 2, 3, 0)], (1, 2, 1, 2), rows=point_rows(1))
    save(tmp_path, "patch", 31, [struct.pack("<i4d", 31, 0, 0, 1, 1)], (0, 0, 1, 1), rows=point_rows(1))
    rows = read_all(spark, tmp_path)
    assert (rows["lines", 0].geometry, decoded(rows["lines", 0])) == ("LINESTRING", a)
    assert (rows["lines", 1].geometry, decoded(rows["lines", 1])) == ("MULTILINESTRING", [a, b])
    assert decoded(rows["linesz", 0]) == [(0.0, 0.0, 3.0), (1.0, 1.0, 4.0)]
    assert (rows["multi", 0].geometry, decoded(rows["multi", 0])) == ("MULTIPOINT", [(0.0, 0.0), (1.0, 1.0)])
    assert decoded(rows["pointz", 0]) == (1.0, 2.0, 3.0)
    assert rows["patch", 0].error == "Shape type 31 is not decoded"
    kinds = {r.layer: r.geometry_type for r in shapefile_headers(spark, str(tmp_path)).collect()}
    assert kinds == {"lines": "Line String", "linesz": "3D Line String", "multi": "Multi Point",
                     "pointz": "3D Point", "patch": "3D Unknown (any)"}


def test_folder_of_layers(spark, tmp_path):
    for stem, upper in (("cities", False), ("RIVERS", True)):
        save(tmp_path, stem, 1, [point_bytes(1, 2)] * 3, (1, 2, 1, 2), rows=point_rows(3), upper=upper)
    save(tmp_path / ".trash", "old", 1, [point_bytes(1, 2)], (1, 2, 1, 2), rows=point_rows(1))
    (tmp_path / "fake.shp").write_text("dummy")
    counts = {(r.layer, r.error is None): r["count"] for r in spark.read.format("shapefile").option("layer", "cities")
              .load(str(tmp_path)).groupBy("layer", "error").count().collect()}
    assert counts == {("cities", True): 3}
    everything = spark.read.format("shapefile").load(str(tmp_path)).groupBy("layer").agg(
        F.count("fid").alias("rows"), F.max("error").alias("error"))
    got = {r.layer: (r.rows, r.error) for r in everything.collect()}
    assert got["cities"] == (3, None) and got["RIVERS"] == (3, None)
    assert got["fake"][0] == 0 and "index file is missing" in got["fake"][1]
    headers = {r.layer: (r.feature_count, r.error is None) for r in shapefile_headers(spark, str(tmp_path)).collect()}
    assert headers == {"cities": (3, True), "RIVERS": (3, True), "fake": (None, False)}


def test_empty_shapefile(spark, tmp_path):
    save(tmp_path, "empty", 5, [], (0, 0, 0, 0))
    row = shapefile_headers(spark, str(tmp_path)).first()
    assert (row.feature_count, row.extent, row.geometry_type) == (0, None, "Polygon")
    assert spark.read.format("shapefile").load(str(tmp_path)).count() == 0


def test_codepage_and_reserved_names(spark, tmp_path):
    columns = [("fid", "N", 4, 0), ("name", "C", 10, 0)]
    save(tmp_path, "plain", 1, [point_bytes(1, 2)], (1, 2, 1, 2), columns, [["9", "Köln"]], prj=None)
    (tmp_path / "plain.cpg").write_text("UTF-8")
    df = spark.read.format("shapefile").load(str(tmp_path / "plain.shp"))
    assert df.columns[:4] == ["layer", "fid", "fid_1", "name"]
    assert tuple(df.select("fid", "fid_1", "name").first()) == (0, 9, "Köln")
    latin = dbf_bytes(columns, [["9", "x"]]).replace(b"x         ", "Köln".encode("latin-1").ljust(10))
    (tmp_path / "plain.dbf").write_bytes(latin)
    (tmp_path / "plain.cpg").write_text("ISO-8859-1")
    assert df.select("name").first()[0] == "Köln"


def test_scattered_records(spark, tmp_path):
    """Records stored in another order than the index names them, with a gap between."""
    save(tmp_path, "odd", 1, [point_bytes(i, i) for i in range(3)], (0, 0, 2, 2), rows=point_rows(3))
    shp, shx = (tmp_path / "odd.shp").read_bytes(), bytearray((tmp_path / "odd.shx").read_bytes())
    moved = shp[100:128]
    (tmp_path / "odd.shp").write_bytes(shp + b"\0" * 4000 + moved)
    shx[100:104] = struct.pack(">i", (len(shp) + 4000) // 2)
    (tmp_path / "odd.shx").write_bytes(bytes(shx))
    got = {r.fid: r.xmin for r in spark.read.format("shapefile").load(str(tmp_path)).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}


def test_folder_of_unlike_layers(spark, tmp_path):
    place = [point_bytes(1, 2)]
    first = [("id", "N", 9, 0), ("name", "C", 8, 0), ("size", "N", 18, 0), ("code", "N", 5, 0), ("when", "D", 8, 0)]
    second = [("ID", "N", 18, 0), ("size", "N", 12, 3), ("code", "C", 6, 0), ("when", "C", 4, 0), ("extra", "C", 5, 0),
              ("EXTRA", "L", 1, 0)]
    save(tmp_path, "a", 1, place, (1, 2, 1, 2), columns=first, rows=[["1", "n", str(2**53 + 1), "07", "20240415"]])
    save(tmp_path, "b", 1, place, (1, 2, 1, 2), columns=second, rows=[[str(10**12), "1.5", "x7", "soon", "more", "T"]])
    save(tmp_path, "c", 1, place, (1, 2, 1, 2), columns=second[:1], rows=[["5"]])
    (tmp_path / "c.dbf").write_bytes(b"damaged")
    df = spark.read.format("shapefile").load(str(tmp_path))
    kinds = dict(df.dtypes)
    names = ["id", "name", "size", "code", "when", "extra", "EXTRA_1"]
    assert df.columns[2:9] == names
    assert [kinds[n] for n in names] == ["bigint", "string", "double", "string", "string", "string", "boolean"]
    rows = {r["layer"]: r for r in df.collect()}
    assert [rows["a"][n] for n in names] == [1, "n", float(2**53), "07", "2024-04-15", None, None]
    assert [rows["b"][n] for n in names] == [10**12, None, 1.5, "x7", "soon", "more", True]
    assert rows["a"]["error"] is None and rows["b"]["error"] is None and rows["c"]["error"]
    only = spark.read.format("shapefile").option("columns", "layer,extra").load(str(tmp_path)).where("layer = 'b'")
    assert [tuple(r) for r in only.collect()] == [("b", "more")]
