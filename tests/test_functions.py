import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan import functions as fn


def values(spark, rows, schema, *columns):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1024**2, 1024**3, 1024**4, 1024**5, 1024**6, -1, 1536000, None, 1024**2 - 1,
             10 * 1024**5 - 1]
    got = values(spark, [(s,) for s in sizes], "s bigint", fn.human_size(F.col("s")))
    assert got == ["0 B", "1023 B", "1.00 KB", "1.00 MB", "1.00 GB", "1.00 TB", "1.00 PB", "1024.00 PB", "0 B",
                   "1.46 MB", None, "1024.00 KB", "10.00 PB"]


def test_double_text_follows_python(spark):
    numbers = [0.0, -0.0, 0.1, 123.0, 9999999.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 1e-3, 1.5e-4, 1e-5, -2.5e-7,
               float("nan"), float("inf"), float("-inf")]
    got = values(spark, [(x,) for x in numbers], "x double", fn.cell_text(F.col("x"), T.DoubleType()))
    assert got == [str(x) for x in numbers]


def test_render_double(spark):
    numbers = [0.0, 0.5, -0.125, 0.9999999, 1.0, 1.005, 2.675, -3.14159, 1e9, float("nan"), float("-inf"),
               float("inf")]
    got = values(spark, [(x,) for x in numbers], "x double", fn.render_value(F.col("x"), T.DoubleType()))
    assert got == [f"{x:.6f}" if abs(x) < 1 else f"{x:.2f}" for x in numbers]


def test_render_other_types(spark):
    schema = T.StructType.fromDDL(
        "b boolean, s string, n int, l array<string>, d struct<k: int, t: string>, i array<struct<v: int>>"
    )
    df = spark.createDataFrame(
        [
            (True, "x", 5, ["a", None], (1, None), [(1,), (2,)]),
            (None, None, None, None, None, None),
            (False, "", 0, [], (2, "y"), []),
        ],
        schema,
    )
    rows = df.select(*[fn.render_value(F.col(f.name), f.dataType).alias(f.name) for f in schema]).collect()
    assert tuple(rows[0]) == ("True", "x", "5", "a, None", "k=1, t=None", "2 items (see below)")
    assert tuple(rows[1]) == ("-",) * 6
    assert tuple(rows[2]) == ("False", "", "0", "-", "k=2, t=y", "-")


def test_extent_text(spark):
    df = spark.createDataFrame([((-180.0, 180.0, -90.0, 90.00005),), (None,)],
                               "e struct<xmin: double, xmax: double, ymin: double, ymax: double>")
    rows = df.select(fn.format_extent(F.col("e")), fn.format_extent(F.col("e"), compact=True)).collect()
    assert tuple(rows[0]) == ("X: [-180.0000, 180.0000]  Y: [-90.0000, 90.0001]",
                              "X:[-180.0000, 180.0000]  Y:[-90.0000, 90.0001]")
    assert tuple(rows[1]) == ("-", "-")


def spans_by_hand(text, query):
    """Search the lower-cased text from left to right, each time behind the last match."""
    found, at = [], text.lower().find(query.lower())
    while query and at >= 0:
        found.append(at)
        at = text.lower().find(query.lower(), at + len(query))
    return found


@pytest.mark.parametrize(
    ("text", "query", "expected"),
    [
        ("banana", "an", [1, 3]),
        ("Berlin", "BERL", [0]),
        ("banana", "xyz", []),
        ("banana", "", []),
        ("aaaa", "aa", [0, 2]),
        ("a.b.c", ".", [1, 3]),
        (r"x\Ey\Ez", r"\E", [1, 4]),
        ("abc" * 100, "C", list(range(2, 300, 3))),
    ],
)
def test_spans(spark, text, query, expected):
    assert values(spark, [(text,)], "t string", fn.highlight_spans(F.col("t"), query)) == [expected]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abAB.\\E ", max_size=60), min_size=1, max_size=8),
       st.text(alphabet="abAB.\\E", min_size=1, max_size=3))
def test_spans_agree_with_a_plain_search(spark, texts, query):
    got = values(spark, [(t,) for t in texts], "t string", fn.highlight_spans(F.col("t"), query))
    assert got == [spans_by_hand(t, query) for t in texts]


def test_spans_of_null(spark):
    assert values(spark, [(None,)], "t string", fn.highlight_spans(F.col("t"), "a")) == [[]]


def test_crs_labels(spark):
    got = values(spark, [("4326", "WGS 84"), (None, "Local"), ("", "Local"), (None, None)], "c string, n string",
                 fn.crs_label(F.col("c"), F.col("n")))
    assert got == ["EPSG:4326 - WGS 84", "Local", "Local", None]


AXES = 'AXIS["x",east,LENGTHUNIT["metre",1]],AXIS["y",north,LENGTHUNIT["metre",1]]'


@pytest.mark.parametrize(
    ("wkt", "label", "linear", "angular"),
    [
        ('GEOGCS["WGS 84",UNIT["degree",0.0174],AUTHORITY["EPSG","4326"]]', "EPSG:4326 - WGS 84", None, "degree"),
        ('PROJCS["a",GEOGCS["b",UNIT["degree",1],AUTHORITY["EPSG","1"]],UNIT["m",1]]', "a", "m", None),
        ('PROJCS["unit [deep]",GEOGCS["b"],UNIT["m",1],AUTHORITY["EPSG","7"]] ', "EPSG:7 - unit [deep]", "m", None),
        ('COMPD_CS["c",GEOGCS["g",UNIT["degree",1],AUTHORITY["EPSG","2"]],VERT_CS["v",UNIT["m",1]]]', "c", None, "degree"),
        ('COMPOUNDCRS["c",PROJCRS["p",BASEGEOGCRS["b",ID["EPSG",1]],CS[Cartesian,2],' + AXES + ',ID["EPSG",2]],ID["EPSG",9]]',
         "EPSG:9 - c", "metre", None),
        ('BOUNDCRS[SOURCECRS[PROJCRS["p",CS[Cartesian,2],' + AXES + ',ID["EPSG",5]]],TARGETCRS[GEOGCRS["t",ID["EPSG",4326]]]]',
         "EPSG:5 - p", "metre", None),
        ('ENGCRS["local",CS[Cartesian,2],' + AXES + "]", "local", None, None),
        ('LOCAL_CS["", UNIT["m",1]]', None, None, None),
        ("", None, None, None),
        (None, None, None, None),
        ("not a system", None, None, None),
    ],
)
def test_systems_by_nesting(spark, wkt, label, linear, angular):
    w = F.col("w")
    row = spark.createDataFrame([(wkt,)], "w string").select(fn.wkt_label(w), fn.crs_units(w).alias("u")).first()
    assert (row[0], row.u and row.u.linear_unit, row.u and row.u.angular_unit) == (label, linear, angular)


@pytest.mark.parametrize(
    ("path", "kind", "label"),
    [
        ("/d/test.shp", "shapefile", "Shapefile"),
        ("/d/dem.TIF", "raster", "Raster"),
        ("/d/photo.gif", "raster", "Raster"),
        ("/d/test.gdb", "geodatabase", "Geodatabase"),
        ("D:\\data\\test.gdb\\", "geodatabase", "Geodatabase"),
        ("/d/test.gdb//", "geodatabase", "Geodatabase"),
        ("/some/file.csv", None, "Input"),
        ("/d/grid.nc", None, "Input"),
        ("/d/noext", None, "Input"),
    ],
)
def test_formats(spark, path, kind, label):
    p = F.col("p")
    row = spark.createDataFrame([(path,)], "p string").select(
        fn.path_format(p), fn.type_label(p), fn.unsupported_message(p)).first()
    assert tuple(row)[:2] == (kind, label)
    assert (row[2] is None) == (kind is not None)


@pytest.mark.parametrize(
    ("path", "hidden", "inside"),
    [
        ("/a/.git/x.tif", True, False),
        ("/a/.x.shp", True, False),
        ("./a/../x.shp", False, False),
        ("/a/b.GDB/t.gdbtable", False, True),
        ("/a/b.gdb/", False, False),
        ("/a/b.gdbx/c.tif", False, False),
    ],
)
def test_hidden_and_inside(spark, path, hidden, inside):
    p = F.col("p")
    row = spark.createDataFrame([(path,)], "p string").select(fn.is_hidden(p), fn.is_inside_container(p)).first()
    assert tuple(row) == (hidden, inside)


def test_stems(spark):
    paths = ["/d/a.b.shp", "/d/x.gdb/", ".hidden", "noext", "c:\\d\\e.tif"]
    p = F.col("p")
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in paths], "p string")
           .select(fn.basename(p), fn.stem(p)).collect()]
    assert got == [("a.b.shp", "a.b"), ("x.gdb", "x"), (".hidden", ".hidden"), ("noext", "noext"), ("e.tif", "e")]
