"""Coordinate system labels and units, read from codes and WKT text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of the format, in both of its versions.
PROJECTED = ("PROJCS", "PROJCRS", "PROJECTEDCRS")
GEOGRAPHIC = ("GEOGCS", "GEOGCRS", "GEOGRAPHICCRS", "GEODCRS", "GEODETICCRS")
WRAPPERS = ("COMPD_CS", "COMPOUNDCRS", "BOUNDCRS", "SOURCECRS")
IDENTIFIERS = ("AUTHORITY", "ID")
LINEAR_UNITS = ("UNIT", "LENGTHUNIT")
ANGULAR_UNITS = ("UNIT", "ANGLEUNIT")

TOKEN = r'"(?:[^"]|"")*"|[A-Za-z_]\w*\s*[\[(]|[\])]|[^\s,"\[\]()]+'
ITEM = "array<struct<path: string, value: string>>"


def crs_label(code: Column, name: Column) -> Column:
    """``EPSG:<code> - <name>`` for the code of any authority; the bare name without a code; null without a system."""
    with_code = F.concat(F.lit("EPSG:"), code.cast("string"), F.lit(" - "), name)
    return F.when(F.length(code.cast("string")) > 0, with_code).otherwise(name)


def wkt_items(wkt: Column) -> Column:
    """The values of a WKT text with the path of the elements they stand in, as ``/PROJCS/GEOGCS/UNIT``.

    The text is cut into names with an opening bracket, closing brackets, quoted and plain values; the path
    grows and shrinks with the brackets, so those inside quotes don't count.
    """
    opened = lambda t: F.upper(F.regexp_extract(t, r"^(\w+)", 1))
    plain = lambda t: F.replace(F.regexp_replace(t, '^"|"$', ""), F.lit('""'), F.lit('"'))

    def step(state: Column, token: Column) -> Column:
        path, items = state["path"], state["items"]
        quoted = F.startswith(token, F.lit('"'))
        opens, closes = ~quoted & token.rlike(r"[\[(]$"), ~quoted & token.rlike(r"^[\])]$")
        deeper = F.concat(path, F.lit("/"), opened(token))
        after = F.when(opens, deeper).when(closes, F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)
        item = F.struct(path.alias("path"), plain(token).alias("value"))
        outside = path == ""
        found = F.when(opens | closes | outside, items).otherwise(F.concat(items, F.array(item)))
        return F.struct(after.alias("path"), found.alias("items"))

    start = F.struct(F.lit("").alias("path"), F.array().cast(ITEM).alias("items"))
    return F.aggregate(F.regexp_extract_all(wkt, F.lit(f"({TOKEN})")), start, step, lambda s: s["items"])


def _value(items: Column, paths: Column, place: int = 0) -> Column:
    """The value at a place among those of the first path that has any; null for an empty one."""
    of_path = F.transform(
        paths, lambda p: F.get(F.transform(F.filter(items, lambda i: i["path"] == p), lambda i: i["value"]), F.lit(place))
    )
    return F.nullif(F.get(F.array_compact(of_path), F.lit(0)), F.lit(""))


def _below(path: Column, *names: str) -> Column:
    return F.array(*[F.concat(path, F.lit(f"/{name}")) for name in names])


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _name(items: Column) -> Column:
    return F.nullif(F.get(items, F.lit(0))["value"], F.lit(""))


def _code(items: Column) -> Column:
    return _let(_below(F.get(items, F.lit(0))["path"], *IDENTIFIERS), lambda paths: _value(items, paths, 1))


def _units(items: Column) -> Column:
    horizontal = f"^(/({'|'.join(WRAPPERS)}))*/({'|'.join((*PROJECTED, *GEOGRAPHIC))})$"
    own = F.get(F.filter(items, lambda i: i["path"].rlike(horizontal)), F.lit(0))["path"]

    def of_kind(path: Column, kinds: tuple[str, ...], names: tuple[str, ...]) -> Column:
        places = _below(path, *names, *[f"AXIS/{name}" for name in names])
        found = _let(places, lambda paths: _value(items, paths))
        return F.when(path.rlike(f"/({'|'.join(kinds)})$"), found)

    return _let(
        own,
        lambda path: F.struct(
            of_kind(path, PROJECTED, LINEAR_UNITS).alias("linear_unit"),
            of_kind(path, GEOGRAPHIC, ANGULAR_UNITS).alias("angular_unit"),
        ),
    )


def wkt_name(wkt: Column) -> Column:
    """Name of a system: of the outermost element, or of the first inside one that has no name of its own."""
    return _let(wkt_items(wkt), _name)


def wkt_authority_code(wkt: Column) -> Column:
    """Code that the element with the system's name is registered under; null when it has none."""
    return _let(wkt_items(wkt), _code)


def wkt_label(wkt: Column) -> Column:
    """Label of the system of a WKT text."""
    return _let(wkt_items(wkt), lambda items: crs_label(_code(items), _name(items)))


def crs_units(wkt: Column) -> Column:
    """``STRUCT<linear_unit, angular_unit>``: the first for projected, the second for geographic.

    Of a compound or bound system the horizontal part counts. Its unit is its own, not that of its base, and
    if it has none that of its first axis.
    """
    return _let(wkt_items(wkt), _units)
