"""The engine's questions asked of the sample tables.

``sf_dir`` is taken as a container whose layers are the tables. Where an input has to be
of another kind (paths, WKT texts, WKB, files), Spark derives it from a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan import functions as fn
from layerscan.functions.paths import below
from layerscan.operators.ordering import with_position
from layerscan.operators.paging import (
    assign_pages,
    feature_rows,
    page_progress,
    preview,
    preview_summary,
    scan_from,
)
from layerscan.operators.profile import array_bands, band_stats, layer_extents
from layerscan.operators.search import match_ring, search_rows
from layerscan.operators.search_index import build_index, search_indexed
from layerscan.plans.dataset import Container, open_dataset
from layerscan.plans.sample_files import write_array_rasters, write_plain_files, write_shapefiles
from layerscan.session import configure, shared_folder
from layerscan.sources import container, shapefile, tiff
from layerscan.sources.discovery import classify_paths, discover, fold_datasets, raster_layers
from layerscan.streaming.files import file_state, profile_of, refresh
from layerscan.streaming.profile import arriving_rows, latest_profile, profile_stream, running_profile
from layerscan.streaming.progress import progress_table, scan_with_progress

LAYERS = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]
BOX = ("xmin", "xmax", "ymin", "ymax")
# What is x and y of the layers that lie anywhere.
AXES = {"customer": ("c_acctbal", "c_nationkey"), "orders": ("o_totalprice", "o_custkey")}

# Paths as they may lie in a file tree, one per row of `part`.
TREE_PATHS = """
    CASE p_partkey % 12
      WHEN 0 THEN concat('/data/', p_brand, '/', p_name, '.shp')
      WHEN 1 THEN concat('/data/', p_brand, '/', p_name, '.TIF')
      WHEN 2 THEN concat('/data/', p_brand, '/', p_name, '.gdb/')
      WHEN 3 THEN concat('/data/', p_brand, '/store.gdb/a', p_partkey, '.gdbtable')
      WHEN 4 THEN concat('/data/.cache/', p_name, '.tif')
      WHEN 5 THEN concat('/data/', p_brand, '/', p_name, '.v2.jpeg')
      WHEN 6 THEN concat('/data/', p_brand, '/', p_name, '.csv')
      WHEN 7 THEN concat('/data/', p_brand, '/', p_name)
      WHEN 8 THEN concat('/data/', p_brand, '/.', p_name, '.shp')
      WHEN 9 THEN concat('/data/', p_brand, '/', p_name, '.GDB//')
      WHEN 10 THEN concat('/data/', p_brand, '/', p_name, '.nc')
      ELSE concat('/data/', p_brand, '/', p_name, '.Dem')
    END
"""

# A listing with sidecars, containers, hidden and other files, one per row of `part`.
LISTED_FILES = """
    CASE p_partkey % 9
      WHEN 0 THEN concat('/data/', p_type, '/layer_', p_partkey - p_partkey % 9, '.shp')
      WHEN 1 THEN concat('/data/', p_type, '/layer_', p_partkey - p_partkey % 9, '.dbf')
      WHEN 2 THEN concat('/data/', p_type, '/layer_', p_partkey - p_partkey % 9, '.shx')
      WHEN 3 THEN concat('/data/x/layer_', p_partkey - p_partkey % 9, '.shp')
      WHEN 4 THEN concat('/data/x/layer_', p_partkey - p_partkey % 9, '.shp.xml')
      WHEN 5 THEN concat('/data/store_', p_size, '.gdb/a', p_partkey, '.gdbtable')
      WHEN 6 THEN concat('/data/', p_type, '/image_', p_partkey, '.tif')
      WHEN 7 THEN concat('/data/.hidden/image_', p_partkey, '.tif')
      ELSE concat('/data/', p_type, '/notes_', p_partkey, '.txt')
    END
"""

# A tree of files on disk, one per row of `customer`; what belongs to a shapefile lies side by side.
TREE_FILES = """
    CASE c_custkey % 10
      WHEN 0 THEN concat('n', c_custkey % 7, '/layer_', c_custkey - c_custkey % 10, '.shp')
      WHEN 1 THEN concat('n', (c_custkey - 1) % 7, '/layer_', c_custkey - c_custkey % 10, '.dbf')
      WHEN 2 THEN concat('n', (c_custkey - 2) % 7, '/layer_', c_custkey - c_custkey % 10, '.shx')
      WHEN 3 THEN concat('n', c_custkey % 7, '/deep/', c_nationkey, '/image_', c_custkey, '.tif')
      WHEN 4 THEN concat('n', c_custkey % 7, '/store_', c_nationkey, '.gdb/a', c_custkey, '.gdbtable')
      WHEN 5 THEN concat('n', c_custkey % 7, '/deep/.cache/image_', c_custkey, '.tif')
      WHEN 6 THEN concat('n', c_custkey % 7, '/deep/', c_nationkey, '/deeper/_', c_custkey, '.png')
      WHEN 7 THEN concat('n', c_custkey % 7, '/alone_', c_custkey, '.shx')
      WHEN 8 THEN concat('n', c_custkey % 7, '/image_', c_custkey, '.jp2')
      ELSE concat('notes_', c_custkey, '.txt')
    END
"""
TREE_BYTES = "CAST(c_custkey % 50 * 40 + c_nationkey AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return container.read_layer(spark, sf_dir, name)


def edges(extent: Column) -> list[Column]:
    return [extent.getField(name).alias(name) for name in BOX]


# --- containers, layers, fields ---------------------------------------------------


def container_info(spark, sf_dir):
    """Rows and fields of every layer, both from the footers."""
    return container.container_catalog(configure(spark), sf_dir).select("layer", "feature_count", "field_count")


def container_counts(spark, sf_dir):
    """Rows of every layer that has any, counted by a scan."""
    return container.container_counts(configure(spark), sf_dir)


def container_footers(spark, sf_dir):
    return container.container_catalog(configure(spark), sf_dir).select(
        "layer", "feature_count", "field_count", "error"
    )


def layer_names(spark, sf_dir):
    return container.layer_names(spark, sf_dir)


def schema_fields(spark, sf_dir):
    return container.schema_table(container.container_catalog(configure(spark), sf_dir))


def search_fields(spark, sf_dir):
    shown = schema_fields(spark, sf_dir).withColumn(
        "nullable", F.when(F.col("nullable"), F.lit("yes")).otherwise(F.lit("no"))
    )
    return search_rows(shown, "KEY", ["name", "alias", "type", "width", "precision", "nullable"])


def search_layers(spark, sf_dir):
    return search_rows(container.layer_names(spark, sf_dir), "AR")


def layer_extent(spark, sf_dir):
    layers = {n: table(spark, sf_dir, n) for n in ("events", "embeddings", "orders", "lineitem")}
    layers["no_rows"] = layers["events"].where(F.col("event_id") < 0)
    axes = {
        "events": (F.col("value"), F.col("user_id")),
        "embeddings": (F.col("embedding")[0], F.col("embedding")[1]),
        "orders": (F.col("o_totalprice"), F.col("o_custkey")),
        "lineitem": (F.col("l_extendedprice"), F.col("l_quantity")),
        "no_rows": (F.col("value"), F.col("user_id")),
    }
    extent = F.col("extent")
    return layer_extents(layers, axes).select(
        "layer",
        "feature_count",
        *edges(extent),
        fn.format_extent(extent).alias("text"),
        fn.format_extent(extent, compact=True).alias("compact_text"),
    )


def _layer_card(spark, sf_dir, requested):
    """One layer's schema facts, with count and extent looked up by name."""
    chosen = container.chosen_layer(configure(spark), sf_dir, requested)
    name = chosen.first()["layer"]  # one row
    # Bounded: the chosen name is a single row.
    card = container.container_catalog(spark, sf_dir, F.broadcast(chosen)).select(
        F.lit("Feature Class").alias("type"), "layer", "field_count"
    )
    nowhere = F.lit(None).cast("double")
    x, y = map(F.col, AXES[name]) if name in AXES else (nowhere, nowhere)
    facts = layer_extents({name: table(spark, sf_dir, name)}, {name: (x, y)})
    return card.join(facts, "layer", "left").select(
        "type", "layer", "field_count", "feature_count", *edges(F.col("extent"))
    )


def layer_card(spark, sf_dir):
    return _layer_card(spark, sf_dir, "customer")


def layer_card_fallback(spark, sf_dir):
    return _layer_card(spark, sf_dir, "no such layer")


def layer_card_orders(spark, sf_dir):
    return _layer_card(spark, sf_dir, "orders")


def unknown_layer(spark, sf_dir):
    return Container(configure(spark), sf_dir).schema("no such layer")


def layer_documents(spark, sf_dir):
    """What the info document says of every layer."""
    catalog = Container(configure(spark), sf_dir, axes=AXES).catalog()
    return catalog.select(
        "layer", "feature_count", "geometry_type", *edges(F.col("extent")), "crs", "field_count", "error"
    )


def info_json(spark, sf_dir):
    """One JSON document per layer, fields nested in order."""
    entry = F.expr("transform(fields, f -> struct(f.name AS name, f.type AS type, f.width AS width))")
    catalog = container.container_catalog(configure(spark), sf_dir)
    document = F.struct("layer", "feature_count", "field_count", entry.alias("fields"))
    return catalog.select("layer", F.to_json(document).alias("document"))


# --- rows, positions, pages -------------------------------------------------------


def peek_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return feature_rows(preview(orders, "o_orderkey"), "o_orderkey")


def peek_sparse(spark, sf_dir):
    return feature_rows(preview(table(spark, sf_dir, "labels"), "doc_id", 25), "doc_id")


def peek_lineitem(spark, sf_dir):
    """The first keys of a layer whose keys repeat; which of equal keys, the row hash says."""
    shown = preview(table(spark, sf_dir, "lineitem"), "l_orderkey", 25)
    return shown.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("shown"))


def scan_from_conversations(spark, sf_dir):
    """What is left after a skip that ends among rows of one key."""
    left = scan_from(table(spark, sf_dir, "conversations"), "conv_id", 31)
    return left.groupBy("conv_id").agg(F.count(F.lit(1)).alias("left"))


def row_positions_lineitem(spark, sf_dir):
    placed = with_position(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return placed.groupBy("l_orderkey").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count_distinct("position").alias("n")
    )


def match_ring_conversations(spark, sf_dir):
    ring = match_ring(table(spark, sf_dir, "conversations"), "conv_id", "the", ["text"])
    return ring.select("conv_id", "match_index")


def peek_nothing(spark, sf_dir):
    return feature_rows(preview(table(spark, sf_dir, "orders"), "o_orderkey", -1), "o_orderkey")


def peek_summary(spark, sf_dir):
    parts = []
    for name, limit in (("orders", 10), ("labels", 1000000), ("events", -3), ("region", 2)):
        counts = preview_summary(table(spark, sf_dir, name), limit)
        parts.append(counts.select(F.lit(name).alias("layer"), "total_features", "showing"))
    return reduce(DataFrame.unionByName, parts)


def scan_dense(spark, sf_dir):
    return scan_from(table(spark, sf_dir, "events"), "event_id", 200)


def scan_sparse(spark, sf_dir):
    return scan_from(table(spark, sf_dir, "labels"), "doc_id", 137)


def scan_documents(spark, sf_dir):
    return scan_from(table(spark, sf_dir, "documents"), "doc_id", 150)


def scan_past_end(spark, sf_dir):
    return scan_from(table(spark, sf_dir, "labels"), "doc_id", 10**9)


def row_positions(spark, sf_dir):
    return with_position(table(spark, sf_dir, "labels"), "doc_id")


def row_pages(spark, sf_dir):
    return assign_pages(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


def page_progress_dense(spark, sf_dir):
    return page_progress(table(spark, sf_dir, "events"), "event_id")


def page_progress_sparse(spark, sf_dir):
    return page_progress(table(spark, sf_dir, "labels"), "doc_id")


# --- search -----------------------------------------------------------------------


def search_events(spark, sf_dir):
    return search_rows(table(spark, sf_dir, "events"), "Error", ["event_type", "props"])


def search_every_column(spark, sf_dir):
    return search_rows(table(spark, sf_dir, "orders"), "99.")


def search_documents(spark, sf_dir):
    return search_rows(table(spark, sf_dir, "documents"), "THE ")


def search_pages(spark, sf_dir):
    return search_rows(table(spark, sf_dir, "pages"), "<TITLE").select("page_id", "url")


def search_conversations(spark, sf_dir):
    return search_rows(table(spark, sf_dir, "conversations"), "é")


def search_nothing(spark, sf_dir):
    return search_rows(table(spark, sf_dir, "events"), "")


def match_ring_events(spark, sf_dir):
    return match_ring(table(spark, sf_dir, "events"), "event_id", "error", ["event_type", "props"])


def match_ring_documents(spark, sf_dir):
    return match_ring(table(spark, sf_dir, "documents"), "doc_id", "tion")


def match_ring_sparse(spark, sf_dir):
    return match_ring(table(spark, sf_dir, "labels"), "doc_id", "0", ["quality"])


def _spans(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    spans = fn.highlight_spans(F.col(text), query)
    found = df.select(key, spans.alias("spans"))
    return found.select(key, F.size("spans").alias("hits"), F.array_join("spans", ",").alias("starts"))


def highlight_spans(spark, sf_dir):
    return _spans(table(spark, sf_dir, "part"), "p_partkey", "p_name", "IN")


def highlight_documents(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "doc_id", "text", "on")


def highlight_pages(spark, sf_dir):
    return _spans(table(spark, sf_dir, "pages"), "page_id", "html", "</P>")


# --- rasters ----------------------------------------------------------------------


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.select(
        "band",
        "valid_count",
        *[(F.round(name, 6) + F.lit(0.0)).alias(name) for name in ("min", "max", "mean", "stddev")],
    )


def band_statistics(spark, sf_dir):
    pixels = array_bands(table(spark, sf_dir, "embeddings"), "embedding")
    return _rounded_stats(band_stats(pixels, ["band"]))


def band_statistics_nodata(spark, sf_dir):
    """Line items as a five-band raster with nodata 0; the last band is nodata throughout."""
    items = table(spark, sf_dir, "lineitem")
    grid = items.select(
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_tax") * 0).alias("cell")
    )
    return _rounded_stats(band_stats(array_bands(grid, "cell"), ["band"], nodata=0))


def raster_extent(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    step_x, step_y = F.col("p_size") * 0.5, F.col("p_size") * -0.25
    columns, rows = F.col("p_size") * 10, F.col("p_partkey") % 7 + 1
    extent = fn.raster_extent(F.col("p_retailprice"), step_x, F.col("p_partkey") * 1.0, step_y, columns, rows)
    return part.select(
        "p_partkey",
        *edges(extent),
        fn.cell_size(step_x).alias("cell_size_x"),
        fn.cell_size(step_y).alias("cell_size_y"),
        fn.format_extent(extent).alias("text"),
    )


# --- paths, labels, values --------------------------------------------------------


def classify(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    tree = table(spark, sf_dir, "part").select(F.expr(TREE_PATHS).alias("path"))
    return classify_paths(urls.unionByName(tree)).drop("clean_path", "error")


def dataset_catalog(spark, sf_dir):
    listing = table(spark, sf_dir, "part").select(
        F.expr(LISTED_FILES).alias("path"), (F.col("p_size") * F.lit(1000)).cast("bigint").alias("length")
    )
    return fold_datasets(listing)


def search_catalog(spark, sf_dir):
    """Datasets of a tree whose label contains the query."""
    return search_rows(dataset_catalog(spark, sf_dir), "IMAGE_1", ["layer"])


def human_size(spark, sf_dir):
    totals = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("total"))
    return totals.select("lang", "total", fn.human_size(F.col("total")).alias("size"))


def human_size_units(spark, sf_dir):
    scaled = F.expr(
        "CASE WHEN doc_id % 7 = 6 THEN -n_chars ELSE n_chars * CAST(power(1024, doc_id % 5) AS BIGINT) END"
    )
    sized = table(spark, sf_dir, "documents").select("doc_id", scaled.alias("bytes"))
    return sized.select("doc_id", "bytes", fn.human_size(F.col("bytes")).alias("size"))


def render_values(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumns(
        {
            "small": F.col("c_acctbal") / 100000,
            "sometimes": F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")),
            "positive": F.col("c_acctbal") > 0,
        }
    )
    names = ["c_name", "c_nationkey", "c_acctbal", "small", "sometimes", "positive"]
    return rows.select("c_custkey", *[fn.render_value(F.col(n), rows.schema[n].dataType).alias(n) for n in names])


def render_nested(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = labels.select(
        "doc_id",
        F.struct("doc_id", "quality", "toxic").alias("as_struct"),
        F.when(F.col("quality") == 1, F.array("quality", "toxic", F.lit(7))).otherwise(
            F.array().cast("array<int>")
        ).alias("as_list"),
        F.array(F.struct(F.col("quality").alias("v")), F.struct(F.col("toxic").alias("v"))).alias("as_items"),
    )
    names = ["as_struct", "as_list", "as_items"]
    return rows.select("doc_id", *[fn.render_value(F.col(n), rows.schema[n].dataType).alias(n) for n in names])


def cell_texts(spark, sf_dir):
    """Text of doubles over many magnitudes, as the search reads them."""
    amount = F.expr(
        "CASE WHEN o_orderkey % 14 < 8 THEN o_totalprice / power(10, 8 - o_orderkey % 14) "
        "ELSE o_totalprice * power(10, o_orderkey % 14 - 8) END"
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("amount"))
    return rows.select("o_orderkey", fn.cell_text(F.col("amount"), T.DoubleType()).alias("text"))


def crs_labels(spark, sf_dir):
    """Labels and units of systems spelled out as WKT per supplier: of both versions, alone, compound and bound."""
    base = """
        'GEOGCS["base",DATUM["d",SPHEROID["s",6378137,298.25]],PRIMEM["Greenwich",0],UNIT["degree",0.017],',
        'AUTHORITY["EPSG","4326"]],PROJECTION["p"],PARAMETER["k",1],'
    """
    wkt = F.expr(
        f"""
        CASE s_suppkey % 8
          WHEN 0 THEN concat('PROJCS["', s_name, '",', {base}, 'UNIT["metre",1],AUTHORITY["EPSG","', 32600 + s_nationkey, '"]]')
          WHEN 1 THEN concat('PROJCS["', s_name, '",', {base}, 'UNIT["US survey foot",0.3048]]')
          WHEN 2 THEN concat('GEOGCS["', s_name, '",DATUM["d",SPHEROID["s",6378137,298.25]],',
               'PRIMEM["Greenwich",0],UNIT["degree",0.017],AUTHORITY["EPSG","', 4000 + s_nationkey, '"]]')
          WHEN 3 THEN concat('COMPD_CS["', s_name, '",PROJCS["flat",', {base}, 'UNIT["foot",0.3],AUTHORITY["EPSG","2000"]],',
               'VERT_CS["h",VERT_DATUM["v",2005],UNIT["fathom",2],AUTHORITY["EPSG","5703"]],AUTHORITY["EPSG","', 6000 + s_nationkey, '"]]')
          WHEN 4 THEN concat('BOUNDCRS[SOURCECRS[GEOGCRS["', s_name, '",DATUM["d",ELLIPSOID["e",6378137,298.25]],CS[ellipsoidal,2],',
               'AXIS["lat",north],AXIS["lon",east],ANGLEUNIT["grad",0.0157],ID["EPSG",', 4600 + s_nationkey, ']]],',
               'TARGETCRS[GEOGCRS["WGS 84",ANGLEUNIT["degree",0.017],ID["EPSG",4326]]],ABRIDGEDTRANSFORMATION["t",METHOD["m"]]]')
          WHEN 5 THEN concat('PROJCRS["a ""[', s_name, '" , BASEGEOGCRS["b",DATUM["d",ELLIPSOID["e",1,2,LENGTHUNIT["mile",1600]]],',
               'ID["EPSG",4258]], CONVERSION["c",METHOD["m",ID["EPSG",9807]]], CS[Cartesian,2],AXIS["(E)",east,ORDER[1],',
               'LENGTHUNIT["kilometre",1000]],AXIS["(N)",north,LENGTHUNIT["kilometre",1000]],ID["EPSG",', 25800 + s_nationkey, ']]')
          WHEN 6 THEN concat('geogcs ( "', s_name, '", UNIT ( "radian", 1 ) )')
        END
        """
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", wkt.alias("wkt"))
    text = F.col("wkt")
    units = fn.crs_units(text)
    return rows.select(
        "s_suppkey",
        fn.wkt_label(text).alias("crs"),
        units.getField("linear_unit").alias("linear_unit"),
        units.getField("angular_unit").alias("angular_unit"),
    )


def geometry_names(spark, sf_dir):
    """Names of WKB values in both byte orders, with and without Z, M and flag bits."""
    part = table(spark, sf_dir, "part")
    code = F.expr("1 + p_partkey % 7 + 1000 * (p_size % 4)")
    flagged = F.when(F.col("p_size") % 8 >= 4, F.lit(0x80000000)).otherwise(F.lit(0)) + code
    big = F.lpad(F.hex(flagged.cast("bigint")), 8, "0")
    little = F.concat(*[F.substring(big, p, 2) for p in (7, 5, 3, 1)])
    wkb = F.unhex(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("01"), little)).otherwise(F.concat(F.lit("00"), big)))
    shape = F.when(F.col("p_partkey") % 11 > 0, wkb)
    return part.select("p_partkey", fn.geometry_name(shape).alias("geometry"))


def layer_geometry_types(spark, sf_dir):
    code = F.when(F.col("p_size") < 32, F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", fn.layer_geometry_type(code).alias("geometry_type"))
    return rows


# --- file sources over files that Spark writes from a table -----------------------


def _spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table, which may be one file, dealt to all tasks that write."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def _event_shapes(spark: SparkSession, sf_dir: str) -> str:
    configure(spark)
    folder = shared_folder(spark, "shapefiles")
    points = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", "value", "props",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.to_date("ts").alias("day"),
        F.col("value").alias("x"), F.when(F.col("event_id") % 10 > 0, F.col("user_id").cast("double")).alias("y"),
    )
    write_shapefiles(_spread(points, "event_id"), folder, "event_id").agg(F.sum("rows")).collect()
    return folder


def shapefile_scan(spark, sf_dir):
    """Every column of the events read back, of their whole length."""
    shapes = shapefile.open_shapefiles(spark, _event_shapes(spark, sf_dir))
    return shapes.select(
        "event_id", "event_type", "user_id", "value", "ts", "day", "props", "geometry", *BOX, "error"
    )


def _part_polygons(spark: SparkSession, sf_dir: str) -> str:
    """Parts as combs along the x axis, the longer the larger the part; each fifth has a second ring."""
    configure(spark)
    folder = shared_folder(spark, "polygons")
    ring = """
        concat(transform(sequence(0, p_size), i -> array(p_partkey + i + {shift}D, p_retailprice + 1)),
               transform(sequence(p_size, 0), i -> array(p_partkey + i + {shift}D, p_retailprice)),
               array(array(p_partkey + {shift}D, p_retailprice + 1)))
    """
    rings = F.when(F.col("p_partkey") % 5 == 0, F.array(*(F.expr(ring.format(shift=n)) for n in (0, 1000))))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"),
        rings.otherwise(F.array(F.expr(ring.format(shift=0)))).alias("rings"),
    )
    write_shapefiles(_spread(parts, "partkey"), folder, "partkey", "polygon", "parts").agg(F.sum("rows")).collect()
    return folder


def polygon_scan(spark, sf_dir):
    """Polygons of very unequal size, with the bytes of their WKB."""
    shapes = shapefile.open_shapefiles(spark, _part_polygons(spark, sf_dir))
    return shapes.select("partkey", "name", "geometry", *BOX, F.length("geometry_wkb").alias("wkb_bytes"), "error")


def polygon_box(spark, sf_dir):
    """The polygons that touch a box, by the zones of the record ranges."""
    plan = shapefile.shapefile_plan(spark, _part_polygons(spark, sf_dir), bytes_per_range=1 << 16)
    shapes = shapefile.read_shapefiles(spark, shapefile.with_zones(spark, plan), ["partkey", *BOX])
    touching = (F.col("xmin") <= 150) & (F.col("xmax") >= 120) & (F.col("ymin") <= 1100) & (F.col("ymax") >= 900)
    return shapes.where(touching).select("partkey", *BOX)


def _unlike_shapefiles(spark: SparkSession, sf_dir: str) -> str:
    """A folder with points of suppliers, points of customers with other columns, and damaged files."""
    configure(spark)
    folder = shared_folder(spark, "unlike")
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("number"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("Name"),
        F.col("c_acctbal").alias("nation"), F.col("c_acctbal").alias("x"), F.lit(None).cast("double").alias("y"),
    )
    write_shapefiles(suppliers, folder, "number", name="suppliers").agg(F.sum("rows")).collect()
    write_shapefiles(customers, folder, "custkey", name="customers").agg(F.sum("rows")).collect()
    broken = table(spark, sf_dir, "region").select(
        F.concat(F.lit("broken_"), F.col("r_regionkey"), F.element_at(F.array(*map(F.lit, (".shp", ".tif"))), F.col("r_regionkey") % 2 + 1)).alias("path"),
        (F.col("r_regionkey") + 1).alias("length"),
    )
    write_plain_files(broken, folder).agg(F.sum("rows")).collect()
    return folder


def shapefile_folder(spark, sf_dir):
    """Unlike shapefiles with the columns of all, and an error for each damaged file among them."""
    shapes = shapefile.open_shapefiles(spark, _unlike_shapefiles(spark, sf_dir))
    kind = F.regexp_extract("layer", r"^([a-z]+)_", 1)
    return shapes.select(kind.alias("kind"), "number", "custkey", "name", "nation", "geometry", "xmin", "error")


def damaged_files(spark, sf_dir):
    """What each file of a folder says of itself, damaged ones included."""
    folder = _unlike_shapefiles(spark, sf_dir)
    name = F.regexp_extract("path", r"([a-z]+)_\d+\.[a-z]+$", 1).alias("kind")
    shapes = shapefile.shapefile_headers(spark, folder).select(
        name, F.coalesce("feature_count", F.lit(0)).alias("features"), F.col("error").isNotNull().alias("damaged")
    )
    images = tiff.raster_headers(spark, folder).select(
        name, F.lit(0).cast("bigint").alias("features"), F.col("error").isNotNull().alias("damaged")
    )
    return shapes.unionByName(images).groupBy("kind", "damaged").agg(F.sum("features").alias("features"))


def shapefile_extent(spark, sf_dir):
    headers = shapefile.shapefile_headers(spark, _event_shapes(spark, sf_dir))
    extent = F.col("extent")
    return headers.groupBy("geometry_type", "crs", "field_count").agg(
        F.sum("feature_count").alias("feature_count"),
        F.min(extent.xmin).alias("xmin"),
        F.max(extent.xmax).alias("xmax"),
        F.min(extent.ymin).alias("ymin"),
        F.max(extent.ymax).alias("ymax"),
    )


def shapefile_geometry(spark, sf_dir):
    """Geometry names read back from the WKB, and how many features have each."""
    shapes = shapefile.open_shapefiles(spark, _event_shapes(spark, sf_dir), columns=["fid", "geometry_wkb"])
    return shapes.groupBy(fn.geometry_name(F.col("geometry_wkb")).alias("geometry")).agg(
        F.count(F.lit(1)).alias("features")
    )


def _embedding_images(spark: SparkSession, sf_dir: str) -> str:
    configure(spark)
    folder = shared_folder(spark, "rasters")
    written = write_array_rasters(table(spark, sf_dir, "embeddings"), folder, "vec_id", "embedding")
    written.agg(F.sum("rows")).collect()
    return folder


def raster_pixels(spark, sf_dir):
    pixels = tiff.raster_pixels(spark, _embedding_images(spark, sf_dir))
    start = F.regexp_extract("path", r"image_(\d+)\.tif$", 1).cast("bigint")
    return pixels.select((start + F.col("row")).alias("vec_id"), "band", (F.round("value", 6) + F.lit(0.0)).alias("value"), "error")


def raster_band_statistics(spark, sf_dir):
    return _rounded_stats(tiff.raster_band_stats(configure(spark), _embedding_images(spark, sf_dir), ["band"]))


def raster_band_statistics_nodata(spark, sf_dir):
    """Line items as rasters of one strip each, cut into shares of a few rows; 0 is nodata."""
    configure(spark)
    folder = shared_folder(spark, "strips")
    items = table(spark, sf_dir, "lineitem")
    grid = items.select(
        F.monotonically_increasing_id().alias("row"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_tax") * 0).alias("cell"),
    )
    write_array_rasters(_spread(grid, "row"), folder, "row", "cell", "0", "<f8", None).agg(F.sum("rows")).collect()
    plan = tiff.raster_plan(spark, folder, bytes_per_share=1 << 16, segment_bytes=1 << 14)
    return _rounded_stats(tiff.raster_band_stats(spark, folder, ["band"], plan))


def raster_bands(spark, sf_dir):
    bands = tiff.band_schema(tiff.raster_headers(spark, _embedding_images(spark, sf_dir)))
    return bands.groupBy("driver", "band_count", "band", "data_type", "color_interp", "block_size", "error").agg(
        F.sum("rows").cast("bigint").alias("rows")
    )


# --- trees of files ---------------------------------------------------------------


def _file_tree(spark: SparkSession, sf_dir: str) -> str:
    configure(spark)
    folder = shared_folder(spark, "tree")
    files = table(spark, sf_dir, "customer").select(F.expr(TREE_FILES).alias("path"), F.expr(TREE_BYTES).alias("length"))
    write_plain_files(_spread(files, "path"), folder).agg(F.sum("rows")).collect()
    return folder


def discover_tree(spark, sf_dir):
    """Datasets of a tree on disk, listed level by level."""
    folder = _file_tree(spark, sf_dir)
    return discover(spark, folder).withColumn("path", below(F.col("path"), folder))


def folder_rasters(spark, sf_dir):
    """The rasters of a tree on disk as layers, by name."""
    folder = _file_tree(spark, sf_dir)
    return raster_layers(discover(spark, folder)).select("layer", below(F.col("path"), folder).alias("path"))


def dataset_size(spark, sf_dir):
    """Sizes of a whole tree, of one folder in it, of one shapefile with its sidecars, and of nothing."""
    folder = _file_tree(spark, sf_dir)
    paths = {"tree": "", "folder": "/n3", "shapefile": "/n0/layer_70.shp", "missing": "/nowhere"}
    sizes = {name: open_dataset(spark, folder + path).size() for name, path in paths.items()}
    parts = [size.select(F.lit(name).alias("name"), "size_bytes", "size") for name, size in sizes.items()]
    return reduce(DataFrame.unionByName, parts)


def stream_profile(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    rows = arriving_rows(spark, sf_dir, schema, "events.parquet")
    profile = running_profile(rows, F.lit("events"), F.col("value"), F.col("user_id"))
    output = shared_folder(spark, "stream")
    query = profile_stream(profile, f"{output}/profile", f"{output}/state")
    query.awaitTermination()
    return latest_profile(spark, f"{output}/profile").select("layer", "feature_count", *edges(F.col("extent")))


def refreshed_profile(spark, sf_dir):
    """Count and extent of layers of which a part was rewritten after the first look."""
    configure(spark)
    base = shared_folder(spark, "layers")
    events = table(spark, sf_dir, "events").withColumns(
        {"layer": F.col("event_type"), "part": F.col("event_id") % 4}
    )
    writer = lambda df: df.write.partitionBy("layer", "part").mode("overwrite")
    writer(events).parquet(f"{base}/files")
    axes = {f"layer={r.layer}": ("value", "user_id") for r in events.select("layer").distinct().collect()}
    refresh(spark, f"{base}/files", f"{base}/state", axes)
    again = events.where((F.col("part") == 1) & (F.col("value") > 50))
    writer(again).option("partitionOverwriteMode", "dynamic").parquet(f"{base}/files")
    refresh(spark, f"{base}/files", f"{base}/state", axes)
    profile = profile_of(file_state(spark, f"{base}/state"))
    return profile.select(F.substring("layer", 7, 100).alias("layer"), "feature_count", *edges(F.col("extent")))


def scan_progress(spark, sf_dir):
    """Rows read so far after each of four micro-batches."""
    configure(spark)
    base = shared_folder(spark, "progress")
    events = table(spark, sf_dir, "events")
    parts = events.withColumn("part", F.col("event_id") % 4).repartition(4, "part")
    parts.write.partitionBy("part").parquet(f"{base}/files")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
    rows = stream.option("maxFilesPerTrigger", 1).parquet(f"{base}/files")
    scan_with_progress(rows, f"{base}/rows", f"{base}/progress", f"{base}/checkpoint").awaitTermination()
    return progress_table(spark, f"{base}/progress", events.count())


def search_indexed_documents(spark, sf_dir):
    """The documents with a text, by the filters of the files they are in."""
    base = shared_folder(spark, "indexed")
    documents = table(configure(spark), sf_dir, "documents")
    documents.repartitionByRange(16, "doc_id").write.parquet(f"{base}/files")
    rows = spark.read.schema(documents.schema).parquet(f"{base}/files")
    build_index(rows, f"{base}/index", ["text", "lang"])
    return search_indexed(rows, f"{base}/index", "THE ", ["text", "lang"])


QUERIES = {
    "container_info": container_info,
    "container_counts": container_counts,
    "container_footers": container_footers,
    "layer_names": layer_names,
    "schema_fields": schema_fields,
    "search_fields": search_fields,
    "search_layers": search_layers,
    "layer_extent": layer_extent,
    "layer_card": layer_card,
    "layer_card_fallback": layer_card_fallback,
    "layer_card_orders": layer_card_orders,
    "unknown_layer": unknown_layer,
    "layer_documents": layer_documents,
    "info_json": info_json,
    "peek_rows": peek_rows,
    "peek_sparse": peek_sparse,
    "peek_lineitem": peek_lineitem,
    "scan_from_conversations": scan_from_conversations,
    "row_positions_lineitem": row_positions_lineitem,
    "match_ring_conversations": match_ring_conversations,
    "peek_nothing": peek_nothing,
    "peek_summary": peek_summary,
    "scan_from": scan_dense,
    "scan_from_sparse": scan_sparse,
    "scan_from_documents": scan_documents,
    "scan_past_end": scan_past_end,
    "row_positions": row_positions,
    "row_pages": row_pages,
    "page_progress": page_progress_dense,
    "page_progress_sparse": page_progress_sparse,
    "search_rows": search_events,
    "search_every_column": search_every_column,
    "search_documents": search_documents,
    "search_pages": search_pages,
    "search_conversations": search_conversations,
    "search_nothing": search_nothing,
    "match_ring": match_ring_events,
    "match_ring_documents": match_ring_documents,
    "match_ring_sparse": match_ring_sparse,
    "highlight_spans": highlight_spans,
    "highlight_documents": highlight_documents,
    "highlight_pages": highlight_pages,
    "band_stats": band_statistics,
    "band_stats_nodata": band_statistics_nodata,
    "raster_extent": raster_extent,
    "classify_paths": classify,
    "dataset_catalog": dataset_catalog,
    "search_catalog": search_catalog,
    "human_size": human_size,
    "human_size_units": human_size_units,
    "render_values": render_values,
    "render_nested": render_nested,
    "cell_texts": cell_texts,
    "crs_labels": crs_labels,
    "geometry_names": geometry_names,
    "layer_geometry_types": layer_geometry_types,
    "shapefile_scan": shapefile_scan,
    "shapefile_extent": shapefile_extent,
    "shapefile_geometry": shapefile_geometry,
    "raster_pixels": raster_pixels,
    "raster_band_stats": raster_band_statistics,
    "raster_band_stats_nodata": raster_band_statistics_nodata,
    "raster_bands": raster_bands,
    "polygon_scan": polygon_scan,
    "polygon_box": polygon_box,
    "shapefile_folder": shapefile_folder,
    "damaged_files": damaged_files,
    "discover_tree": discover_tree,
    "raster_layers": folder_rasters,
    "dataset_size": dataset_size,
    "stream_profile": stream_profile,
    "refreshed_profile": refreshed_profile,
    "scan_progress": scan_progress,
    "search_indexed": search_indexed_documents,
}
