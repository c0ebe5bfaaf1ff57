"""Geometry type names from WKB bytes and from layer type codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# WKB base type codes and their names.
WKB_NAMES = {
    1: "POINT",
    2: "LINESTRING",
    3: "POLYGON",
    4: "MULTIPOINT",
    5: "MULTILINESTRING",
    6: "MULTIPOLYGON",
    7: "GEOMETRYCOLLECTION",
    8: "CIRCULARSTRING",
    9: "COMPOUNDCURVE",
    10: "CURVEPOLYGON",
    11: "MULTICURVE",
    12: "MULTISURFACE",
    13: "CURVE",
    14: "SURFACE",
    15: "POLYHEDRALSURFACE",
    16: "TIN",
    17: "TRIANGLE",
}

# Shape type codes of a shapefile header and their layer type names.
SHAPE_TYPE_NAMES = {
    0: "Unknown (any)",
    1: "Point",
    3: "Line String",
    5: "Polygon",
    8: "Multi Point",
    11: "3D Point",
    13: "3D Line String",
    15: "3D Polygon",
    18: "3D Multi Point",
    21: "Measured Point",
    23: "Measured Line String",
    25: "Measured Polygon",
    28: "Measured Multi Point",
    31: "3D Unknown (any)",
}


def _lookup(table: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def geometry_name(wkb: Column) -> Column:
    """Upper-case geometry name of a WKB value; null for null.

    Byte order comes from the first byte. Z and M variants carry the name of their base
    type, both in the +1000/2000/3000 numbering and with the high flag bits.
    """
    code_hex = F.hex(F.substring(wkb, 2, 4))
    swapped = F.concat(*[F.substring(code_hex, p, 2) for p in (7, 5, 3, 1)])
    little = F.hex(F.substring(wkb, 1, 1)) == "01"
    code = F.conv(F.when(little, swapped).otherwise(code_hex), 16, 10).cast("bigint")
    base = (code.bitwiseAND(F.lit(0x0FFFFFFF)) % 1000).cast("int")
    return F.when(F.length(wkb) >= 5, F.try_element_at(_lookup(WKB_NAMES), base))


def layer_geometry_type(shape_type: Column) -> Column:
    """Layer type name of a shapefile type code; null marks a table without geometry."""
    named = F.try_element_at(_lookup(SHAPE_TYPE_NAMES), shape_type.cast("int"))
    return F.when(shape_type.isNull(), F.lit("None")).otherwise(
        F.coalesce(named, F.lit("Unknown (any)"))
    )
