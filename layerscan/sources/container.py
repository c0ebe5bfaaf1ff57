"""A container: one folder holding many named layers as Parquet.

A layer is ``<root>/<layer>.parquet``, either a file or a folder of part files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerscan.functions.geometry import geometry_name
from layerscan.functions.paths import below
from layerscan.functions.types import field_type_name
from layerscan.operators.profile import extent_of
from layerscan.session import shared_folder
from layerscan.sources.discovery import list_files
from layerscan.sources.files import open_file

LAYER_PATTERN = r"(?i)^([^/]+?)(\.parquet)?(/|$)"

BOX = ("xmin", "xmax", "ymin", "ymax")
FOOTER_SCHEMA = """
    path STRING, length BIGINT, layer STRING, num_rows BIGINT, error STRING,
    fields ARRAY<STRUCT<ordinal: INT, name: STRING, alias: STRING, type: STRING,
                        width: INT, precision: INT, nullable: BOOLEAN>>,
    groups INT, has_shape BOOLEAN, edges STRING, xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE
"""


def layer_of(path: Column, root: str) -> Column:
    """Layer name of a file path: the first name below the root, without its ending."""
    return F.regexp_extract(below(path, root), LAYER_PATTERN, 1)


def container_files(spark: SparkSession, root: str) -> DataFrame:
    """Parquet files of a container with their layer name, from the listing alone."""
    files = list_files(spark, root).where(F.col("path").rlike(r"(?i)\.parquet$"))
    return files.withColumn("layer", layer_of(F.col("path"), root))


def layer_names(spark: SparkSession, root: str) -> DataFrame:
    """Layer names in code point order."""
    return container_files(spark, root).select("layer").distinct().orderBy("layer")


def chosen_layer(spark: SparkSession, root: str, requested: str | None) -> DataFrame:
    """The requested layer if there is one of that name, else the first; a single row."""
    layer = F.col("layer")
    names = container_files(spark, root).agg(
        F.max(F.when(layer == F.lit(requested), layer)).alias("asked"), F.min(layer).alias("first")
    )
    return names.select(F.coalesce("asked", "first").alias("layer"))


def read_layer(spark: SparkSession, root: str, layer: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{layer}.parquet")


def _footer_rows(axes: dict[str, tuple[str, str]]):
    """What the footer of each file says; the edges are those of the layer's ``axes``, or of box columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.to_pylist():
                row = {**file, "num_rows": None, "error": None, "fields": [], "groups": 0, "has_shape": False, "edges": "none"}
                try:
                    with open_file(file["path"]) as handle:
                        footer = pq.ParquetFile(handle)
                        row |= {"num_rows": footer.metadata.num_rows, "fields": _fields(footer.schema_arrow)}
                        row |= _located(footer, edge_columns(axes, file["layer"]))
                except Exception as problem:
                    row["error"] = f"Could not open layer file: {type(problem).__name__}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_FOOTER_ARROW)

    return run


def _fields(schema: pa.Schema) -> list[dict]:
    from pyspark.sql.pandas.types import from_arrow_type

    return [
        {
            "ordinal": i,
            "name": f.name,
            "alias": "",
            "type": field_type_name(from_arrow_type(f.type)),
            "width": 0,
            "precision": 0,
            "nullable": f.nullable,
        }
        for i, f in enumerate(schema, start=1)
    ]


def edge_columns(axes: dict[str, tuple[str, str]], layer: str) -> dict[str, str]:
    """The column that each edge of a layer's extent is taken from."""
    if layer in axes:
        x, y = axes[layer]
        return {"xmin": x, "xmax": x, "ymin": y, "ymax": y}
    return {name: name for name in BOX}


def _is_number(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind)


def _located(footer: pq.ParquetFile, columns: dict[str, str]) -> dict:
    """Whether a file has its edges in the footer (``known``), only in its pages (``scan``) or not at all
    (``none``), the edges known, whether it has shapes, and its row groups."""
    schema = footer.schema_arrow
    shape = schema.get_field_index("geometry_wkb")
    found = {"groups": footer.metadata.num_row_groups, "has_shape": shape >= 0 and pa.types.is_binary(schema.field(shape).type)}
    places = {edge: schema.get_field_index(column) for edge, column in columns.items()}
    given = columns["xmin"] == columns["xmax"]  # axes may be whole numbers, a box is made of real ones
    fits = _is_number if given else pa.types.is_floating
    if any(at < 0 or not fits(schema.field(at).type) for at in places.values()):
        return found
    chunks = {footer.metadata.schema.column(n).path: n for n in range(footer.metadata.num_columns)}
    box: dict = {}
    for edge, column in columns.items():
        box[edge] = None
        for group in range(footer.metadata.num_row_groups):
            chunk = footer.metadata.row_group(group).column(chunks[column])
            facts = chunk.statistics
            if facts is not None and facts.has_null_count and facts.null_count == chunk.num_values:
                continue
            if facts is None or not facts.has_min_max:
                return {**found, "edges": "scan"}
            value = float(facts.min if edge.endswith("min") else facts.max)
            if value != value:
                return {**found, "edges": "scan"}
            box[edge] = value if box[edge] is None else (min if edge.endswith("min") else max)(box[edge], value)
    return {**found, "edges": "known", **box}


_FIELD_ARROW = pa.struct(
    [
        ("ordinal", pa.int32()),
        ("name", pa.string()),
        ("alias", pa.string()),
        ("type", pa.string()),
        ("width", pa.int32()),
        ("precision", pa.int32()),
        ("nullable", pa.bool_()),
    ]
)
_FOOTER_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("length", pa.int64()),
        ("layer", pa.string()),
        ("num_rows", pa.int64()),
        ("error", pa.string()),
        ("fields", pa.list_(_FIELD_ARROW)),
        ("groups", pa.int32()),
        ("has_shape", pa.bool_()),
        ("edges", pa.string()),
        *((name, pa.float64()) for name in BOX),
    ]
)


def container_footers(
    spark: SparkSession, root: str, only: DataFrame | None = None, axes: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """One row per file: rows, size, fields, and what its footer tells of its extent.

    Footers are read by the executors, file by file; no data page is touched. Unreadable
    files show up in ``error``. ``only`` names the layers wanted, in a column ``layer``; the
    others' files are not opened.
    """
    files = container_files(spark, root)
    if only is not None:
        files = files.join(only, "layer", "left_semi")
    return footers_of(files, axes)


def footers_of(files: DataFrame, axes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The footers of given files (``path``, ``length``, ``layer``)."""
    return files.select("path", "length", "layer").mapInArrow(_footer_rows(axes or {}), FOOTER_SCHEMA)


def catalog_of(footers: DataFrame) -> DataFrame:
    """One row per layer from the footers of its files. The fields are those of its first file."""
    return (
        footers.groupBy("layer")
        .agg(
            F.sum("num_rows").alias("feature_count"),
            F.sum("length").alias("size_bytes"),
            F.min_by("fields", "path").alias("fields"),
            F.max("error").alias("error"),
        )
        .withColumn("field_count", F.size("fields"))
    )


def container_catalog(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """One row per layer from the file footers: rows, size, fields."""
    return catalog_of(container_footers(spark, root, only))


def _all_layers(spark: SparkSession, root: str, columns: str) -> DataFrame:
    """Chosen columns of all layers in one scan, with the layer name; null
    where a layer has no such column. The number of layers does not matter to the plan."""
    reader = spark.read.schema(columns).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(root)
    # The path comes encoded as in a URI, where a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select("*", layer_of(path, root).alias("layer"))


def container_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per layer, counted in a scan that reads no column."""
    rows = _all_layers(spark, root, "_none STRING").select("layer")
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("feature_count"))


def _scan_groups(axes: dict[str, tuple[str, str]]):
    """The edges, or the first bytes of the shapes, in single row groups of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = edge_columns(axes, row["layer"])
                with open_file(row["path"]) as handle:
                    file = pq.ParquetFile(handle)
                    wanted = sorted(set(columns.values())) if row["wanted"] == "edges" else ["geometry_wkb"]
                    parts = file.iter_batches(ROWS_AT_ONCE, row_groups=[row["group"]], columns=wanted)
                    rows = [_scanned(part, columns, row) for part in parts]
                yield pa.RecordBatch.from_pylist([r for found in rows for r in found], schema=_SCANNED_ARROW)

    return run


def _scanned(part: pa.RecordBatch, columns: dict[str, str], row: dict) -> list[dict]:
    if row["wanted"] == "shapes":
        heads = pc.binary_slice(part["geometry_wkb"], 0, WKB_HEAD_BYTES).unique().drop_null()
        return [{"layer": row["layer"], "path": row["path"], "head": head} for head in heads.to_pylist()]
    box: dict = {"layer": row["layer"], "path": row["path"]}
    for edge, column in columns.items():
        values = part[column].cast(pa.float64(), safe=False)
        values = values.filter(pc.invert(pc.is_nan(values)))
        box[edge] = pc.min_max(values)[edge[1:]].as_py()
    return [box]


_SCANNED_ARROW = pa.schema([("layer", pa.string()), ("path", pa.string()), ("head", pa.binary()), *((n, pa.float64()) for n in BOX)])
_SCANNED = "layer STRING, path STRING, head BINARY, xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE"
ROWS_AT_ONCE = 1 << 16
WKB_HEAD_BYTES = 5


def extents_of(
    footers: DataFrame, axes: dict[str, tuple[str, str]] | None = None, by: tuple[str, ...] = ("layer",)
) -> DataFrame:
    """Extent and geometry names per layer, or per file, from the footers of files (a written table).

    Where the footers hold the least and the greatest of the columns, nothing else is read. The row groups of
    other files, and of those with shapes, are rows of a table, and tasks read one after the
    other. The set of names is as small as the list of geometry types. What is not a number is no
    coordinate. Layers without coordinates have a row without.
    """
    groups = F.when(F.col("groups") > 0, F.sequence(F.lit(0), F.col("groups") - 1))
    wanted = F.array_compact(
        F.array(F.when(F.col("edges") == "scan", F.lit("edges")), F.when(F.col("has_shape"), F.lit("shapes")))
    )
    open_groups = (
        footers.where(F.col("error").isNull())
        .select("path", "layer", F.explode(wanted).alias("wanted"), groups.alias("groups"))
        .select("path", "layer", "wanted", F.explode("groups").alias("group"))
        .repartition(footers.sparkSession.sparkContext.defaultParallelism, "path", "group", "wanted")
    )
    scanned = open_groups.mapInArrow(_scan_groups(axes or {}), _SCANNED)
    known = footers.select("layer", "path", F.lit(None).cast("binary").alias("head"), *BOX)
    edges = map(F.col, BOX)
    names = F.array_compact(F.collect_set(geometry_name(F.col("head"))))
    return (
        known.unionByName(scanned)
        .groupBy(*by)
        .agg(extent_of(*edges).alias("extent"), names.alias("geometry_names"))
    )


def container_extents(spark: SparkSession, root: str) -> DataFrame:
    """Extent from the box columns and geometry names from the WKB column, per layer."""
    return extents_of(written_footers(spark, root))


def written_footers(spark: SparkSession, root: str, axes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The footers of a container as a table in the shared folder, for all that is asked of them."""
    folder = shared_folder(spark, "footers")
    container_footers(spark, root, axes=axes).write.parquet(folder)
    return spark.read.schema(FOOTER_SCHEMA).parquet(folder)


def schema_table(catalog: DataFrame) -> DataFrame:
    """One row per field of every layer."""
    return catalog.select("layer", F.inline("fields"))
