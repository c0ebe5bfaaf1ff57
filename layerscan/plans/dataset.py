"""The questions one asks of a dataset: what is it, which layers, which columns, where,
and show me rows.

Every answer is a DataFrame. What cannot be answered comes back as one row with an
``error``, not as an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.geometry import geometry_name
from layerscan.functions.paths import extension, unsupported_message
from layerscan.functions.text import human_size
from layerscan.operators.ordering import key_layout
from layerscan.operators.paging import PREVIEW_ROWS, feature_rows, preview, preview_summary, scan_from
from layerscan.operators.profile import layer_extents
from layerscan.operators.search import match_ring, search_rows
from layerscan.session import configure
from layerscan.sources import container, shapefile, tiff
from layerscan.sources.discovery import fold_datasets, list_tree
from layerscan.sources.files import path_exists

SHORT_FIELDS = "transform(fields, f -> struct(f.name AS name, f.type AS type, f.width AS width))"
BOX = ("xmin", "xmax", "ymin", "ymax")

# What is said when there is no answer.
LAYER_NOT_FOUND = "Layer not found: "
NO_LAYERS = "No layers in dataset"
NO_SHAPEFILE = "No shapefile found"
CANNOT_OPEN_RASTER = "Could not open raster dataset"
# Our own words.
CANNOT_OPEN = "No layer here can be read"
NO_RASTER_PEEK = "A raster has no rows to preview; its pixels and band statistics can be read."

# Layer type name for a geometry name.
LAYER_TYPE_NAMES = {
    "POINT": "Point",
    "LINESTRING": "Line String",
    "POLYGON": "Polygon",
    "MULTIPOINT": "Multi Point",
    "MULTILINESTRING": "Multi Line String",
    "MULTIPOLYGON": "Multi Polygon",
    "GEOMETRYCOLLECTION": "Geometry Collection",
}


def error_row(spark: SparkSession, message: str) -> DataFrame:
    return spark.range(1).select(F.lit(message).alias("error"))


class Dataset:
    """What all dataset kinds share. ``path`` is kept as given, without trailing separators."""

    label = "Input"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    @property
    def name(self) -> str:
        return self.path.replace("\\", "/").rsplit("/", 1)[-1]

    def exists(self) -> bool:
        return path_exists(self.path)

    def size(self) -> DataFrame:
        """Bytes of all files of the dataset, and the same as text."""
        if not self.exists():
            empty = F.lit(0).cast("bigint")
            return self.spark.range(1).select(empty.alias("size_bytes"), human_size(empty).alias("size"))
        return self._size_of(list_tree(self.spark, self._size_root()))

    def _size_root(self) -> str:
        return self.path

    def _size_of(self, files: DataFrame) -> DataFrame:
        total = F.coalesce(F.sum("length"), F.lit(0))
        return files.agg(total.alias("size_bytes")).withColumn("size", human_size(F.col("size_bytes")))

    def catalog(self) -> DataFrame:
        """One row per layer: layer, feature_count, geometry_type, extent, crs, field_count,
        fields, error."""
        raise NotImplementedError

    def read(self, layer: str) -> tuple[DataFrame, str, Column | None]:
        """Rows of a layer, the name of its row key and its geometry name."""
        raise NotImplementedError

    def keys(self, layer: str) -> DataFrame:
        """The row keys of a layer alone."""
        df, key, _ = self.read(layer)
        return df.select(key)

    def layers(self) -> DataFrame:
        """Layer names in order."""
        if not self.exists():
            return self.spark.range(0).select(F.lit("").alias("layer"))
        return self.catalog().select("layer").orderBy("layer")

    def first_layer(self) -> str | None:
        return self.layers().agg(F.min("layer")).first()[0] if self.exists() else None

    def info(self) -> DataFrame:
        """One row per layer with everything the catalog knows, plus the dataset's own facts."""
        if not self.exists():
            return self.spark.range(1).select(
                F.lit(self.label).alias("type"),
                F.lit(self.path).alias("path"),
                F.lit(self.name).alias("name"),
                F.lit(False).alias("exists"),
                F.lit("0 B").alias("size"),
                F.lit(0).alias("layer_count"),
            )
        return self.catalog().select(
            F.lit(self.label).alias("type"),
            F.lit(self.path).alias("path"),
            F.lit(self.name).alias("name"),
            F.lit(True).alias("exists"),
            F.lit(self.size().first()["size"]).alias("size"),
            "layer",
            "feature_count",
            "geometry_type",
            "extent",
            "crs",
            "field_count",
            F.expr(SHORT_FIELDS).alias("fields"),
            "error",
        )

    def info_document(self, pretty: bool = False) -> DataFrame:
        """The whole answer as one JSON text, layers nested by name.

        This gathers one entry per layer. For a tree of very many datasets write
        ``info()`` as JSON lines instead.
        """
        rows = self.info()
        if "layer" in rows.columns:
            entry = F.struct(
                F.col("layer").alias("name"), "feature_count", "geometry_type", "extent", "crs", "fields", "error"
            )
            rows = rows.groupBy("type", "path", "name", "exists", "size").agg(
                F.count(F.lit(1)).alias("layer_count"), F.sort_array(F.collect_list(entry)).alias("layers")
            )
        options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
        return rows.select(F.to_json(F.struct("*"), options).alias("document"))

    def _of_layer(self, answer: DataFrame, layer: str | None) -> DataFrame:
        """Rows of one layer, or a row saying that there is no such layer."""
        if layer is None:
            return answer
        if not self._has(layer):
            return error_row(self.spark, LAYER_NOT_FOUND + layer)
        return answer.where(F.col("layer") == layer)

    def _has(self, layer: str) -> bool:
        return not self.layers().where(F.col("layer") == layer).isEmpty()

    def schema(self, layer: str | None = None) -> DataFrame:
        """One row per field of a layer, or of all layers."""
        if not self.exists():
            return error_row(self.spark, self._cannot_open())
        return self._of_layer(self._field_rows(), layer)

    def _field_rows(self) -> DataFrame:
        catalog = self.catalog()
        return catalog.select(
            "layer", "geometry_type", "field_count", "error", F.explode_outer("fields").alias("_field")
        ).select("layer", "geometry_type", "field_count", "_field.*", "error")

    def extent(self, layer: str | None = None) -> DataFrame:
        """Extent and coordinate system of a layer, or of all layers."""
        if not self.exists():
            return error_row(self.spark, self._cannot_open())
        return self._of_layer(self.catalog().select("layer", "crs", "extent", "error"), layer)

    def _cannot_open(self) -> str:
        return CANNOT_OPEN

    def _with_layer(self, layer: str | None, then: Callable[[str], DataFrame]) -> DataFrame:
        """Run on the named layer, or on the first one when none is named."""
        if not self.exists():
            return error_row(self.spark, self._cannot_open())
        if layer is None:
            layer = self.first_layer()
            return error_row(self.spark, NO_LAYERS) if layer is None else then(layer)
        return then(layer) if self._has(layer) else error_row(self.spark, LAYER_NOT_FOUND + layer)

    def peek(self, limit: int = PREVIEW_ROWS, layer: str | None = None) -> DataFrame:
        """The first rows of a layer in key order."""

        def rows(name: str) -> DataFrame:
            df, key, shape = self.read(name)
            return self._features(preview(df, key, limit, self.keys(name)), key, shape)

        return self._with_layer(layer, rows)

    def summary(self, limit: int = PREVIEW_ROWS, layer: str | None = None) -> DataFrame:
        """Layer, rows in all, rows a preview shows."""

        def counts(name: str) -> DataFrame:
            return preview_summary(self.keys(name), limit).select(F.lit(name).alias("layer"), "total_features", "showing")

        return self._with_layer(layer, counts)

    def rows(self, layer: str | None = None, skip: int = 0) -> DataFrame:
        """Every row of a layer from a position on."""

        def scan(name: str) -> DataFrame:
            df, key, shape = self.read(name)
            return self._features(scan_from(df, key, skip, self.keys(name)), key, shape)

        return self._with_layer(layer, scan)

    def search(self, query: str, layer: str | None = None) -> DataFrame:
        """Rows of a layer with a cell that contains the query."""

        def hits(name: str) -> DataFrame:
            df, key, shape = self.read(name)
            return search_rows(self._features(df, key, shape), query)

        return self._with_layer(layer, hits)

    def matches(self, query: str, layer: str | None = None) -> DataFrame:
        """For each matching row its place among the matches, the next and the previous one."""

        def ring(name: str) -> DataFrame:
            df, key, shape = self.read(name)
            layout = key_layout(self.keys(name), key)
            return match_ring(self._features(df, key, shape), "fid", query, layout=layout)

        return self._with_layer(layer, ring)

    def _features(self, df: DataFrame, key: str, shape: Column | None) -> DataFrame:
        return feature_rows(df, key, shape)


class Container(Dataset):
    """A folder of Parquet layers.

    ``keys`` names the row key of a layer (default: a column ``fid``, else the first
    integer column). ``axes`` names the x and y of a layer without box columns.
    """

    label = "File Geodatabase"

    def __init__(self, spark, path, keys: dict[str, str] | None = None,
                 axes: dict[str, tuple[str, str]] | None = None):
        super().__init__(spark, path)
        self.key_columns, self.axes = keys or {}, axes or {}

    def read(self, layer):
        df = container.read_layer(self.spark, self.path, layer)
        shape = geometry_name(F.col("geometry_wkb")) if "geometry_wkb" in df.columns else None
        return df, self.key_columns.get(layer) or _default_key(df), shape

    def layers(self) -> DataFrame:
        if not self.exists():
            return super().layers()
        return container.layer_names(self.spark, self.path)

    def info(self) -> DataFrame:
        if self.exists() and not self._readable():
            return self.spark.range(1).select(
                F.lit(self.label).alias("type"),
                F.lit(self.path).alias("path"),
                F.lit(self.name).alias("name"),
                F.lit(True).alias("exists"),
                F.lit(self.size().first()["size"]).alias("size"),
                F.lit(0).alias("layer_count"),
                F.lit(self._cannot_open()).alias("error"),
            )
        return super().info()

    def schema(self, layer: str | None = None) -> DataFrame:
        return super().schema(layer) if self._readable() else error_row(self.spark, self._cannot_open())

    def extent(self, layer: str | None = None) -> DataFrame:
        return super().extent(layer) if self._readable() else error_row(self.spark, self._cannot_open())

    def _with_layer(self, layer, then):
        return super()._with_layer(layer, then) if self._readable() else error_row(self.spark, self._cannot_open())

    def _readable(self) -> bool:
        """A folder named like a container may hold no layer of ours."""
        return self.exists() and self.first_layer() is not None

    def catalog(self) -> DataFrame:
        """Counts, fields and extents from one pass over the file footers; only files that don't
        give the least and greatest of their coordinates there are read further."""
        names = F.col("geometry_names")
        footers = container.written_footers(self.spark, self.path, self.axes)
        catalog = container.catalog_of(footers).join(container.extents_of(footers, self.axes), "layer", "left")
        return catalog.select(
            "layer",
            "feature_count",
            F.when(F.size(names) == 1, _type_name(names[0]))
            .when(F.size(names) > 1, F.lit("Unknown (any)"))
            .otherwise(F.lit("None"))
            .alias("geometry_type"),
            "extent",
            F.lit(None).cast("string").alias("crs"),
            "field_count",
            "fields",
            "error",
        )


def _type_name(shape: Column) -> Column:
    pairs = [F.lit(x) for pair in LAYER_TYPE_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), shape), F.lit("Unknown (any)"))


def _default_key(df: DataFrame) -> str:
    for field in df.schema.fields:
        if field.name.lower() == "fid":
            return field.name
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            return field.name
    raise ValueError("the layer has no integer column to order its rows by; name one in keys")


class Shapefile(Dataset):
    """One shapefile, or a folder of them taken as layers."""

    label = "Shapefile"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self._plans: dict[str, shapefile.ShapefilePlan] = {}

    def catalog(self) -> DataFrame:
        return shapefile.shapefile_headers(self.spark, self.path)

    def _load(self, layer: str, columns: list[str] | None = None) -> DataFrame:
        return shapefile.read_shapefiles(self.spark, self._plan(layer), columns)

    def _plan(self, layer: str) -> shapefile.ShapefilePlan:
        """The record ranges of a layer, planned when it is first asked for."""
        if layer not in self._plans:
            self._plans[layer] = shapefile.shapefile_plan(self.spark, self.path, layer)
        return self._plans[layer]

    def read(self, layer):
        """fid, attributes and geometry name; the source is not asked for the rest."""
        extras = {"layer", "geometry_wkb", *BOX, "error"}
        wanted = [c for c in self._plan(layer).schema.names if c not in extras]
        return self._load(layer, wanted), "fid", F.col("geometry")

    def keys(self, layer: str) -> DataFrame:
        return self._load(layer, ["fid"])

    def _features(self, df, key, shape):
        return df

    def _size_root(self) -> str:
        return self.path.rsplit("/", 1)[0] if self.path.lower().endswith(".shp") else self.path

    def _size_of(self, files: DataFrame) -> DataFrame:
        """A single shapefile counts with all its sidecars, a folder with all its files."""
        if not self.path.lower().endswith(".shp"):
            return super()._size_of(files)
        own = fold_datasets(files, self._size_root())
        own = own.where(_plain_path(F.col("path")) == _plain_path(F.lit(self.path)))
        return super()._size_of(own.select(F.col("size_bytes").alias("length")))

    def _one(self, layer: str | None) -> str | None:
        """Schema and extent of a folder without a layer name mean its first shapefile."""
        return layer or self.first_layer()

    def schema(self, layer=None):
        return super().schema(self._one(layer)) if self.exists() else super().schema(layer)

    def extent(self, layer=None):
        return super().extent(self._one(layer)) if self.exists() else super().extent(layer)

    def _cannot_open(self) -> str:
        return NO_SHAPEFILE


class Raster(Dataset):
    """One raster, or a folder of them."""

    label = "Raster"

    def _headers(self) -> DataFrame:
        return tiff.raster_headers(self.spark, self.path)

    def layers(self) -> DataFrame:
        if not self.exists():
            return super().layers()
        return self._headers().select("layer").distinct().orderBy("layer")

    def info(self) -> DataFrame:
        """One row per raster: geometry, coordinate system and bands with exact statistics."""
        if not self.exists():
            return super().info()
        bands = tiff.band_schema(self._headers()).select("path", "band", "data_type", "nodata")
        stats = tiff.raster_band_stats(self.spark, self.path)
        stats = stats.withColumn("_file", _plain_path(F.col("path"))).drop("path", "valid_count", "error")
        per_band = bands.withColumn("_file", _plain_path(F.col("path"))).join(stats, ["_file", "band"], "left")
        entry = F.struct("band", "data_type", "nodata", "min", "max", "mean", "stddev")
        listed = per_band.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("bands"))
        return (
            tiff.raster_geometry(self._headers())
            .join(listed, "path", "left")
            .withColumns({"type": F.lit(self.label), "size": F.lit(self.size().first()["size"])})
        )

    def info_document(self, pretty: bool = False) -> DataFrame:
        options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
        return self.info().select(F.to_json(F.struct("*"), options).alias("document"))

    def schema(self, layer: str | None = None) -> DataFrame:
        if not self.exists():
            return error_row(self.spark, self._cannot_open())
        return self._of_layer(tiff.band_schema(self._headers()), layer)

    def extent(self, layer: str | None = None) -> DataFrame:
        if not self.exists():
            return error_row(self.spark, self._cannot_open())
        found = tiff.raster_geometry(self._headers()).select(
            "layer", "path", "extent", "cell_size_x", "cell_size_y", "crs", "error"
        )
        return self._of_layer(found, layer)

    def peek(self, limit: int = PREVIEW_ROWS, layer: str | None = None) -> DataFrame:
        return error_row(self.spark, NO_RASTER_PEEK)

    summary = rows = search = matches = peek

    def pixels(self) -> DataFrame:
        """Every pixel as ``path, band, row, col, value``."""
        return tiff.raster_pixels(self.spark, self.path)

    def _cannot_open(self) -> str:
        return CANNOT_OPEN_RASTER


def _plain_path(path: Column) -> Column:
    """Local paths alike, whether written with the file scheme or without."""
    return F.regexp_replace(path, "^file:/*", "/")


class Unsupported(Dataset):
    """A path no format claims: every question is answered with the same error."""

    def _answer(self, *args, **kwargs) -> DataFrame:
        return self.spark.range(1).select(unsupported_message(F.lit(self.path)).alias("error"))

    info = info_document = layers = schema = extent = peek = summary = rows = search = matches = _answer


def open_dataset(spark: SparkSession, path: str, **options) -> Dataset:
    """The dataset at a path, by its extension; a plain folder by what lies in it."""
    configure(spark)
    clean = path.rstrip("/\\") or path
    lower = clean.lower()
    if lower.endswith(".shp"):
        return Shapefile(spark, clean)
    if lower.endswith(tuple("." + e for e in tiff.RASTER_EXTENSIONS)):
        return Raster(spark, clean)
    if lower.endswith(".gdb"):
        return Container(spark, clean, **options)
    endings = set()
    if path_exists(clean):
        kinds = ["shp", "parquet", *tiff.RASTER_EXTENSIONS]
        listed = list_tree(spark, clean).select(extension(F.col("path")).alias("ending"))
        endings = {r.ending for r in listed.where(F.col("ending").isin(kinds)).distinct().collect()}
    if "shp" in endings:
        return Shapefile(spark, clean)
    if "parquet" in endings:
        return Container(spark, clean, **options)
    if endings & set(tiff.RASTER_EXTENSIONS):
        return Raster(spark, clean)
    return Unsupported(spark, clean)
