"""Find the datasets below a folder from a file listing, without opening a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from layerscan.functions.paths import (
    RASTER_EXTENSIONS,
    SHAPEFILE_EXTENSION,
    basename,
    below,
    extension,
    format_of,
    is_hidden,
    is_inside_container,
    label_of,
    path_format,
    stem,
    trim_separators,
    unsupported_message,
)
from layerscan.functions.text import human_size
from layerscan.session import shared_folder
from layerscan.sources.files import list_entries

# Files that belong to the shapefile of the same stem.
SIDECAR_EXTENSIONS = ["shx", "dbf", "prj", "cpg", "sbn", "sbx", "qix", "qpj", "ain", "aih", "idm", "ind"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of every file below a folder.

    The content column is pruned, so nothing is read; large trees are listed in parallel.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified`` (nanoseconds) of every file at or below a path, whatever its name.

    The frontier is a table: each round lists the folders that the one before it found, in
    tasks, and writes what lies in them to the shared folder, until no folder is left. No list is
    longer than one folder, and the driver sees only whether there are folders. Links to
    folders are not followed.
    """
    written = shared_folder(spark, "listing")
    level, number = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        seen = Observation()
        listed = level.mapInArrow(_list_folders, _ENTRIES).observe(seen, F.count_if("folder").alias("folders"))
        listed.write.parquet(f"{written}/level={number}")
        folders = seen.get["folders"]
        if not folders:
            break
        found = spark.read.schema(_ENTRIES).parquet(f"{written}/level={number}").where("folder")
        tasks = max(spark.sparkContext.defaultParallelism, -(-folders // FOLDERS_PER_TASK))
        level, number = found.select("path").repartition(min(tasks, folders)), number + 1
    entries = spark.read.schema(_ENTRIES).option("basePath", written).parquet(f"{written}/level=*")
    return entries.where("not folder").select("path", "length", "modified")


def shown_files(files: DataFrame, root: str) -> DataFrame:
    """Files below a root whose names, and those of their folders, start with neither a dot nor an
    underscore. The root's own name does not matter, nor if it is the file itself."""
    itself = F.endswith(F.col("path"), F.lit(root.removeprefix("file:").rstrip("/")))
    return files.where(itself | ~below(F.col("path"), root).rlike(r"(^|/)[._]"))


FOLDERS_PER_TASK = 1000
_ENTRIES = "path string, length bigint, folder boolean, modified bigint"
_ENTRY_TYPES = (pa.string(), pa.int64(), pa.bool_(), pa.int64())


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            found = list_entries(path)
            for at in range(0, len(found), 10_000):
                columns = zip(*found[at : at + 10_000], strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, _ENTRY_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "length", "folder", "modified"])


def classify_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Name, stem, extension, format and visibility of each path."""
    p = F.col(path)
    named = paths.select(
        p.alias("path"),
        trim_separators(p).alias("clean_path"),
        basename(p).alias("name"),
        stem(p).alias("stem"),
        extension(p).alias("extension"),
        is_hidden(p).alias("hidden"),
        is_inside_container(p).alias("inside_container"),
    ).withColumn("format", format_of(F.col("extension")))
    shown = ~F.col("hidden") & ~F.col("inside_container") & F.col("format").isNotNull()
    return named.select(
        "*",
        label_of(F.col("format")).alias("type_label"),
        shown.alias("is_dataset"),
        unsupported_message(F.col("path")).alias("error"),
    )


def fold_datasets(files: DataFrame, root: str = "") -> DataFrame:
    """Fold a file listing into datasets with their size.

    Files inside a geodatabase count towards that geodatabase, the sidecars of a
    shapefile towards the shapefile; hidden entries, sidecars without a shapefile and
    other files are left out. Sums are partial before the shuffle, so one huge container
    is no hot group. Only names below ``root`` count as hidden, not its own.
    """
    path, ext, container = F.col("path"), F.col("_ext"), F.col("_container")
    visible = files.where(~is_hidden(below(path, root) if root else path)).select(
        "path",
        "length",
        F.when(path.rlike(r"(?i)\.shp\.xml$"), F.lit("shp.xml")).otherwise(extension(path)).alias("_ext"),
        F.regexp_extract(path, r"(?i)^(.*?\.gdb)[/\\]", 1).alias("_container"),
    )
    inside = container != ""
    of_shapefile = ext.isin(SHAPEFILE_EXTENSION, "shp.xml", *SIDECAR_EXTENSIONS)
    bare = F.left(path, F.length(path) - F.length(ext))
    owner = (
        F.when(inside, container)
        .when(of_shapefile, F.concat(bare, F.lit(SHAPEFILE_EXTENSION)))
        .when(ext.isin(RASTER_EXTENSIONS), path)
    )
    main = F.when(inside, container).when(ext.isin(SHAPEFILE_EXTENSION, *RASTER_EXTENSIONS), path)
    folded = (
        visible.select(owner.alias("_owner"), "length", main.alias("_main"))
        .where(F.col("_owner").isNotNull())
        .groupBy("_owner")
        .agg(
            F.max("_main").alias("path"),
            F.sum("length").alias("size_bytes"),
            F.count(F.lit(1)).alias("file_count"),
        )
        .where(path.isNotNull())
        .withColumn("format", path_format(path))
    )
    return folded.select(
        "path",
        stem(path).alias("layer"),
        "format",
        label_of(F.col("format")).alias("type_label"),
        "file_count",
        "size_bytes",
        human_size(F.col("size_bytes")).alias("size"),
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """All datasets below a folder, with size; one row each."""
    return fold_datasets(list_tree(spark, root), root)


def raster_layers(datasets: DataFrame) -> DataFrame:
    """Rasters of a discovered folder as layers, by name."""
    return datasets.where(F.col("format") == "raster").select("layer", "path").orderBy("layer", "path")
