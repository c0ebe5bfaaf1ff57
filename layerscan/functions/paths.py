"""Path expressions: names, extensions and the format a path stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions a dataset is recognised by.
SHAPEFILE_EXTENSION = "shp"
CONTAINER_EXTENSION = "gdb"
RASTER_EXTENSIONS = ["tif", "tiff", "jp2", "png", "jpg", "jpeg", "gif", "img", "vrt", "dem"]

FORMATS = {
    "shapefile": [SHAPEFILE_EXTENSION],
    "raster": RASTER_EXTENSIONS,
    "geodatabase": [CONTAINER_EXTENSION],
}


def trim_separators(path: Column) -> Column:
    """The path without trailing slashes of either kind."""
    return F.regexp_replace(path, r"[/\\]+$", "")


def below(path: Column, root: str) -> Column:
    """The part of a path below a folder; the whole path when it lies elsewhere."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    start = root.rstrip("/") + "/"
    at = F.instr(path, start)
    return F.when(at > 0, F.substring(path, at + len(start), F.length(path))).otherwise(path)


def basename(path: Column) -> Column:
    return F.regexp_extract(trim_separators(path), r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """Last name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(trim_separators(path), r"\.([A-Za-z0-9]+)$", 1))


def format_of(ext: Column) -> Column:
    """``shapefile``, ``raster`` or ``geodatabase`` for an extension; null for any other."""
    chain = None
    for name, members in FORMATS.items():
        chain = (F if chain is None else chain).when(ext.isin(members), F.lit(name))
    return chain


def path_format(path: Column) -> Column:
    """The format a path stands for; null when it is none."""
    return format_of(extension(path))


def label_of(fmt: Column) -> Column:
    """Title word for a format: Shapefile, Raster, Geodatabase, or Input when null."""
    return F.coalesce(F.initcap(fmt), F.lit("Input"))


def type_label(path: Column) -> Column:
    """Title word for a path."""
    return label_of(path_format(path))


def unsupported_message(path: Column) -> Column:
    """The error text for a path no format claims; null for a supported path."""
    known = ", ".join("." + e for e in [SHAPEFILE_EXTENSION, CONTAINER_EXTENSION, *RASTER_EXTENSIONS])
    text = F.concat(F.lit("Unsupported input type: "), path, F.lit(f". Supported: {known}"))
    return F.when(path_format(path).isNull(), text)


def is_hidden(path: Column) -> Column:
    """True when any component of the path starts with a dot."""
    return path.rlike(r"(^|[/\\])\.(?!\.?([/\\]|$))")


def is_inside_container(path: Column) -> Column:
    """True when some ancestor directory is a geodatabase."""
    return path.rlike(r"(?i)\.gdb[/\\]+[^/\\]")
