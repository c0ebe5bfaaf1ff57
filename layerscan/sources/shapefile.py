"""Shapefiles as a Spark source.

``open_shapefiles(spark, path)`` reads one shapefile or every shapefile below a folder. The columns
are the union of theirs by name, each in the wider type. Tasks list the folder, read the heads
of the attribute tables, and cut each file by its index into record ranges of like bytes, however unequal its
records are. The ranges are a table; a task reads those of its share, and seeks straight to
their bytes. Filters on ``fid`` cut ranges; with ``with_zones``, filters on the box columns leave
out ranges whose box lies outside.

``spark.read.format("shapefile").load(path)`` reads the same without a plan, for one file or a small
folder: the driver lists it and cuts by numbers of rows. ``shapefile_headers`` answers type,
count, extent and fields from headers alone.

Options: ``layer`` (stem of the one file to read), ``columns`` (comma-separated, to leave
out columns, above all ``geometry_wkb``), ``rowsPerPartition``.
"""

from __future__ import annotations

import datetime
import struct
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from layerscan.functions.crs import wkt_label
from layerscan.functions.geometry import layer_geometry_type
from layerscan.functions.paths import extension, stem
from layerscan.session import shared_folder
from layerscan.sources.discovery import list_tree, shown_files
from layerscan.sources.files import list_sizes, open_file, plain_path
from layerscan.sources.shares import BYTES_PER_SHARE, Plan, Share, planned, share_rows, task_shares, write_plan
from layerscan.sources.wkb import polygon_wkb, polyline_wkb, multipoint_wkb, point_wkb

ROWS_PER_PARTITION = 200_000
ROWS_PER_BATCH = 8_192
HEADERS_AT_ONCE = 16
HEADER_BYTES = 100
INDEX_ENTRY_BYTES = 8
RECORD_HEAD_BYTES = 8
#: Bytes of a range of records, about; index entries read at a time while cutting.
BYTES_PER_RANGE = 8 << 20
ENTRIES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Field:
    """A column of the attribute table."""

    name: str
    kind: str
    width: int
    decimals: int
    offset: int

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "N" and self.decimals == 0 and self.width < 19:
            return T.IntegerType() if self.width < 10 else T.LongType()
        if self.kind in "NF":
            return T.DoubleType()
        return {"D": T.DateType(), "L": T.BooleanType()}.get(self.kind, T.StringType())

    @property
    def type_name(self) -> str:
        from layerscan.functions.types import field_type_name

        return field_type_name(self.spark_type)

    @property
    def column(self) -> str:
        return f"{self.name}_1" if self.name.lower() in RESERVED else self.name


FRONT = [T.StructField("layer", T.StringType()), T.StructField("fid", T.LongType())]
BACK = [
    T.StructField("geometry", T.StringType()),
    T.StructField("geometry_wkb", T.BinaryType()),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
    T.StructField("error", T.StringType()),
]
RESERVED = {f.name for f in FRONT + BACK}
BOX_COLUMNS = ("xmin", "xmax", "ymin", "ymax")
NO_INDEX = "index file is missing"


@dataclass(frozen=True)
class TableHeader:
    header_bytes: int
    record_bytes: int
    encoding: str
    fields: list[Field]


def read_table_header(path: str, encoding: str | None = None) -> TableHeader:
    """Field descriptors of an attribute table."""
    with open_file(path) as handle:
        head = handle.read(32)
        header_bytes, record_bytes = struct.unpack("<HH", head[8:12])
        block = handle.read(header_bytes - 32)
    fields, offset = [], 1
    for start in range(0, len(block) - 31, 32):
        entry = block[start : start + 32]
        if entry[0] == 0x0D:
            break
        name = entry[:11].split(b"\0")[0].decode("latin-1").strip()
        fields.append(Field(name, chr(entry[11]), entry[16], entry[17], offset))
        offset += entry[16]
    language = "cp1252" if head[29] in (0x03, 0x57) else "latin-1"
    return TableHeader(header_bytes, record_bytes, encoding or language, fields)


def column_names(fields: list[Field]) -> list[str]:
    """Names of the columns of one file. A name that comes again, in any case, gets a number."""
    taken, names = Counter(), []
    for f in fields:
        name = f.column
        while taken[name.lower()]:
            name = f"{f.column}_{taken[f.column.lower()]}"
            taken[f.column.lower()] += 1
        taken[name.lower()] += 1
        names.append(name)
    return names


def _wider(one: T.DataType, other: T.DataType) -> T.DataType:
    """The type that holds values of both; text when they aren't both numbers."""
    order = [T.IntegerType(), T.LongType(), T.DoubleType()]
    if one == other:
        return one
    if one in order and other in order:
        return max(one, other, key=order.index)
    return T.StringType()


def _fields_or_none(path: str) -> list[Field]:
    """Fields of an attribute table; none of a damaged one, whose rows say so in ``error``."""
    try:
        return read_table_header(path).fields
    except (OSError, ValueError, struct.error):
        return []


def _merged(found: dict[str, T.StructField], name: str, kind: T.DataType, width: int, precision: int) -> None:
    """Add a column of one file to those known by lower-cased name."""
    known, size = found.get(name.lower()), {"width": width, "precision": precision}
    if known:
        name, kind = known.name, _wider(known.dataType, kind)
        size = {k: max(v, known.metadata[k]) for k, v in size.items()}
    found[name.lower()] = T.StructField(name, kind, True, {"alias": "", **size})


def union_of_fields(tables: list[str]) -> list[T.StructField]:
    """Columns of any of the attribute tables, by name without regard to case."""
    found: dict[str, T.StructField] = {}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        for fields in pool.map(_fields_or_none, tables):
            for f, name in zip(fields, column_names(fields), strict=True):
                _merged(found, name, f.spark_type, f.width, f.decimals)
    return list(found.values())


def _first_readable(base: str, ext: str) -> str | None:
    for candidate in (f"{base}.{ext}", f"{base}.{ext.upper()}"):
        if list_sizes(candidate):
            return candidate
    return None


def _codepage(path: str | None) -> str | None:
    """Python encoding named by a codepage file."""
    if path is None:
        return None
    with open_file(path) as handle:
        text = handle.read().decode("ascii", "ignore").strip().lower()
    if text.isdigit():
        return {"65001": "utf-8", "88591": "latin-1"}.get(text, f"cp{text}")
    return text or None


# --- attribute values -------------------------------------------------------------


def _texts(raw: np.ndarray, encoding: str) -> pa.Array:
    """Fixed-width byte rows as trimmed strings, empty ones null."""
    rows, width = raw.shape
    packed = np.ascontiguousarray(raw)
    if rows == 0 or width == 0:
        return pa.nulls(rows, pa.string())
    if encoding == "utf-8" or not (packed & 0x80).any():
        fixed = pa.Array.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(packed)])
        try:
            texts = fixed.cast(pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([bytes(r).decode("utf-8", "replace") for r in packed])
    else:
        texts = pa.array([bytes(r).decode(encoding, "replace") for r in packed])
    texts = pc.utf8_trim(texts, " \0\t\r\n")
    return pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts)


def _date(text: str | None) -> datetime.date | None:
    try:
        return datetime.datetime.strptime(text or "", "%Y%m%d").date()
    except ValueError:
        return None


def decode_values(
    raw: np.ndarray, field: Field, encoding: str, target: T.DataType | None = None
) -> pa.Array:
    """One attribute column of a block of records, in a wider type if one is asked for."""
    texts = _texts(raw[:, field.offset : field.offset + field.width], encoding)
    kind = field.spark_type
    if isinstance(target, T.StringType) and field.kind in "NF":
        return texts  # numbers as they are written
    if isinstance(target, T.DoubleType) and isinstance(kind, T.LongType):
        kind = target  # not every long is a double
    if isinstance(kind, (T.IntegerType, T.LongType, T.DoubleType)):
        number = pc.match_substring_regex(texts, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        plain = pc.replace_substring_regex(
            pc.if_else(number, texts, pa.scalar(None, pa.string())), r"^\+", ""
        )
        values = plain.cast(pa.float64())
        if isinstance(kind, T.DoubleType):
            return values
        whole = pc.match_substring_regex(plain, r"^-?\d+$")
        exact = pc.if_else(whole, plain, pa.scalar(None, pa.string())).cast(pa.int64())
        exact = pc.coalesce(exact, pc.trunc(values).cast(pa.int64()))
        return exact.cast(pa.int32()) if isinstance(kind, T.IntegerType) else exact
    if isinstance(kind, T.DateType):
        return pa.array([_date(t) for t in texts.to_pylist()], pa.date32())
    if isinstance(kind, T.BooleanType):
        meaning = {"T": True, "Y": True, "F": False, "N": False}
        return pa.array([meaning.get((t or "").upper()) for t in texts.to_pylist()], pa.bool_())
    return texts


# --- geometry ---------------------------------------------------------------------


LINE_HEAD = struct.pack("<BI", 1, 2)
ONE_RING_HEAD = struct.pack("<BII", 1, 3, 1)


def _decode_shape(content: memoryview, with_wkb: bool):
    """``(name, wkb, box, error)`` of one record's content."""
    if len(content) < 4:
        return None, None, None, None
    (code,) = struct.unpack_from("<i", content, 0)
    base, has_z, has_m = code % 10, 10 < code < 20, 20 < code < 30
    if code == 0:
        return None, None, None, None
    if base not in (1, 3, 5, 8) or code > 30:
        return None, None, None, f"Shape type {code} is not decoded"
    if base == 1:
        x, y = struct.unpack_from("<2d", content, 4)
        extra = struct.unpack_from("<d", content, 20) if has_z or has_m else ()
        return "POINT", point_wkb(x, y, extra, has_m) if with_wkb else None, (x, x, y, y), None
    xmin, ymin, xmax, ymax = struct.unpack_from("<4d", content, 4)
    box = (xmin, xmax, ymin, ymax)
    if base == 8:
        (points,) = struct.unpack_from("<i", content, 36)
        parts, at = np.zeros(1, "<i4"), 40
    else:
        count, points = struct.unpack_from("<2i", content, 36)
        if count == 1 and not has_z and not has_m:
            name, head = ("LINESTRING", LINE_HEAD) if base == 3 else ("POLYGON", ONE_RING_HEAD)
            body = content[48 : 48 + 16 * points]
            if len(body) < 16 * points:
                raise ValueError("record is cut off")
            return name, head + struct.pack("<I", points) + bytes(body) if with_wkb else None, box, None
        parts, at = np.frombuffer(content, "<i4", count, 44), 44 + 4 * count
    xy = np.frombuffer(content, "<f8", 2 * points, at).reshape(points, 2)
    third = None
    if has_z or has_m:
        third_at = at + 16 * points + 16
        if third_at + 8 * points <= len(content):
            third = np.frombuffer(content, "<f8", points, third_at)
    build = {3: polyline_wkb, 5: polygon_wkb, 8: multipoint_wkb}[base]
    name, wkb = build(xy, parts, third, has_m, with_wkb)
    return name, wkb, box, None


def _decode_points(block: bytes, base: int, offsets: np.ndarray, with_wkb: bool) -> dict | None:
    """All records at once when every one is a plain point; None when one is not."""
    at = (offsets - base + 8)[:, None]
    raw = np.frombuffer(block, np.uint8)[at + np.arange(20)]
    if (raw[:, :4].view("<i4") != 1).any():
        return None
    x, y = np.ascontiguousarray(raw[:, 4:12]).view("<f8").ravel(), np.ascontiguousarray(raw[:, 12:]).view("<f8").ravel()
    columns = {"xmin": x, "xmax": x, "ymin": y, "ymax": y}
    columns = {name: pa.array(values) for name, values in columns.items()}
    columns["geometry"] = pa.repeat("POINT", len(raw))
    if with_wkb:
        # WKB puts a byte order mark before the same little-endian code and coordinates.
        wkb = np.concatenate([np.ones((len(raw), 1), np.uint8), raw], axis=1)
        fixed = pa.Array.from_buffers(pa.binary(21), len(raw), [None, pa.py_buffer(np.ascontiguousarray(wkb))])
        columns["geometry_wkb"] = fixed.cast(pa.binary())
    return columns


def _decode_shapes(block: bytes, base: int, offsets: np.ndarray, lengths: np.ndarray, with_wkb: bool) -> dict:
    """Geometry columns of a block of records; a damaged record says so in ``error``."""
    if (lengths == 20).all() and offsets.max() - base + 28 <= len(block):
        columns = _decode_points(block, base, offsets, with_wkb)
        if columns is not None:
            return columns
    names, wkbs, boxes, errors = [], [], [], []
    view = memoryview(block)
    for offset, length in zip(offsets.tolist(), lengths.tolist(), strict=True):
        start = offset - base + 8
        try:
            name, wkb, box, error = _decode_shape(view[start : start + length], with_wkb)
        except (struct.error, ValueError) as problem:
            name, wkb, box, error = None, None, None, f"Damaged geometry: {problem}"
        names.append(name)
        wkbs.append(wkb)
        boxes.append(box)
        errors.append(error)
    columns = {"geometry": names, "geometry_wkb": wkbs, "error": errors}
    for place, name in enumerate(("xmin", "xmax", "ymin", "ymax")):
        columns[name] = [None if b is None else b[place] for b in boxes]
    return columns


# --- source -----------------------------------------------------------------------


@dataclass(frozen=True)
class Piece:
    """Records ``low`` up to ``high`` of one shapefile."""

    layer: str
    shp: str
    shx: str | None
    dbf: str | None
    cpg: str | None
    low: int
    high: int
    problem: str | None = None


@dataclass
class RecordRanges(InputPartition):
    pieces: list[Piece]

    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


def find_shapefiles(path: str, layer: str | None = None) -> list[dict]:
    """Shapefiles at or below a path with sidecars and record count, by name.

    Extensions are matched without regard to case; hidden entries are left out.
    """
    path = plain_path(path.rstrip("/"))
    single = path.lower().endswith(".shp")
    root = path.rsplit("/", 1)[0] if single else path
    sizes = list_sizes(path)
    if single and sizes:
        base = next(iter(sizes))[: -len(".shp")]
        for ext in ("shx", "dbf", "cpg"):
            found = _first_readable(base, ext)
            if found:
                sizes.update(list_sizes(found))
    by_lower = {name.lower(): name for name in sizes}
    found = []
    for name in sorted(sizes):
        inner = name[len(root) :] if name.startswith(root) else name
        hidden = any(part.startswith(".") for part in inner.split("/"))
        if not name.lower().endswith(".shp") or hidden:
            continue
        base = name[: -len(".shp")]
        entry = {ext: _sidecar(by_lower, sizes, base, ext) for ext in ("shx", "dbf", "cpg")}
        entry.update(layer=base.rsplit("/", 1)[-1], shp=name)
        size = sizes[entry["shx"]] if entry["shx"] else 0
        entry["records"] = max(0, size - HEADER_BYTES) // INDEX_ENTRY_BYTES
        if layer is None or entry["layer"] == layer:
            found.append(entry)
    return found


def _sidecar(by_lower: dict[str, str], sizes: dict[str, int], base: str, ext: str) -> str | None:
    for candidate in (f"{base}.{ext}", f"{base}.{ext.upper()}"):
        if candidate in sizes:
            return candidate
    return by_lower.get(f"{base}.{ext}".lower())


class ShapefileSource(DataSource):
    """One row per feature: layer, fid, attributes, geometry name and WKB, box, error."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        files = find_shapefiles(self.options["path"], self.options.get("layer"))
        if not files:
            wanted = self.options.get("layer")
            raise ValueError(f"Layer not found: {wanted}" if wanted else "No shapefile found")
        attributes = union_of_fields([f["dbf"] for f in files if f["dbf"]])
        every = FRONT + attributes + BACK
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return T.StructType([f for f in every if not wanted or f.name in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShapefileReader(schema, dict(self.options))


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.target = schema
        self.path = options.get("path")
        self.plan = planned(options)
        self.layer = options.get("layer")
        self.least, self.most = {}, {}  # what filters ask of the box columns
        self.rows_per_partition = int(options.get("rowsperpartition", ROWS_PER_PARTITION))
        self.low, self.high = 0, None

    def pushFilters(self, filters: list) -> Iterator:
        """Take over comparisons on ``fid``; they cut record ranges before any read. Those on the box
        columns are noted, to leave out ranges, and stay filters."""
        for item in filters:
            self._note(item)
            on_fid = getattr(item, "attribute", None) == ("fid",) and isinstance(getattr(item, "value", None), int)
            if on_fid and isinstance(item, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, item.value + isinstance(item, GreaterThan))
            elif on_fid and isinstance(item, (LessThan, LessThanOrEqual)):
                self._end_at(item.value + isinstance(item, LessThanOrEqual))
            elif on_fid and isinstance(item, EqualTo):
                self.low = max(self.low, item.value)
                self._end_at(item.value + 1)
            else:
                yield item

    def _note(self, item) -> None:
        column, value = getattr(item, "attribute", ("",))[0], getattr(item, "value", None)
        if column in BOX_COLUMNS and isinstance(value, (int, float)) and value == value:
            if isinstance(item, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.least[column] = max(value, self.least.get(column, value))
            if isinstance(item, (LessThan, LessThanOrEqual, EqualTo)):
                self.most[column] = min(value, self.most.get(column, value))

    def outside(self, zone: dict | None) -> bool:
        """Whether no record of a zone (least and greatest of each box column) can pass the filters."""
        if zone is None:
            return False
        lows, highs = ({c: zone[f"{c}_{end}"] for c in BOX_COLUMNS} for end in ("low", "high"))
        return any(highs[c] is None or highs[c] < v for c, v in self.least.items()) or any(
            lows[c] is None or lows[c] > v for c, v in self.most.items()
        )

    def pieces(self, partition: InputPartition) -> list[Piece]:
        """The record ranges of a partition that filters leave, cut to the ``fid``s asked for."""
        if not isinstance(partition, Share):
            return partition.pieces
        found = []
        for row in share_rows(self.plan, partition.first, partition.last):
            zone, places = row.pop("zone", None), {c: row[c] for c in ("layer", "shp", "shx", "dbf", "cpg")}
            low = max(row["low"] or 0, self.low)
            high = row["high"] or 0 if self.high is None else min(row["high"] or 0, self.high)
            if row["problem"] or (low < high and not self.outside(zone)):
                found.append(Piece(**places, low=low, high=max(low, high), problem=row["problem"]))
        return found

    def _end_at(self, end: int) -> None:
        self.high = end if self.high is None else min(self.high, end)

    def partitions(self) -> list[InputPartition]:
        """The shares of the plan; without one, cut large files into record ranges and put small ones together."""
        if self.plan:
            return task_shares(self.plan)
        groups, group, filled = [], [], 0
        for f in find_shapefiles(self.path, self.layer):
            end = f["records"] if self.high is None else min(f["records"], self.high)
            low = self.low
            unreadable = f["shx"] is None
            while low < end or unreadable:
                high = min(end, low + self.rows_per_partition - filled)
                group.append(Piece(f["layer"], f["shp"], f["shx"], f["dbf"], f["cpg"], low, max(low, high)))
                filled += max(1, high - low)
                low, unreadable = max(low, high), False
                if filled >= self.rows_per_partition:
                    groups.append(RecordRanges(group))
                    group, filled = [], 0
        if group or not groups:
            groups.append(RecordRanges(group))
        return groups

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for piece in self.pieces(partition):
            try:
                yield from self._read_piece(piece)
            except (OSError, ValueError, struct.error) as problem:
                yield self._batch(
                    1, {"layer": [piece.layer], "error": [f"Could not open shapefile: {problem}"]}
                )

    def _read_piece(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.problem:
            raise ValueError(piece.problem)
        if piece.shx is None:
            raise ValueError(NO_INDEX)
        wanted = set(self.target.names)
        header = read_table_header(piece.dbf, _codepage(piece.cpg)) if piece.dbf else None
        columns_by_name = {f.name.lower(): f for f in self.target}
        fields = header.fields if header else []
        named = zip(fields, column_names(fields), strict=True)
        fields = [(f, columns_by_name[n.lower()]) for f, n in named if n.lower() in columns_by_name]
        shape_columns = wanted & {f.name for f in BACK}
        for low in range(piece.low, piece.high, ROWS_PER_BATCH):
            high = min(piece.high, low + ROWS_PER_BATCH)
            columns, keep = {}, np.ones(high - low, bool)
            if header:
                raw = _read_records(piece.dbf, header, low, high)
                keep[: len(raw)] = raw[:, 0] != ord("*")
                for f, column in fields:
                    values = decode_values(raw, f, header.encoding, column.dataType)
                    missing = high - low - len(raw)
                    columns[column.name] = (
                        pa.concat_arrays([values, pa.nulls(missing, values.type)]) if missing else values
                    )
            if shape_columns:
                columns.update(_read_shapes(piece, low, high, "geometry_wkb" in wanted))
            columns["fid"] = pa.array(np.arange(low, high))
            columns["layer"] = pa.repeat(piece.layer, high - low)
            yield self._batch(high - low, columns).filter(pa.array(keep))

    def _batch(self, rows: int, columns: dict) -> pa.RecordBatch:
        arrow = to_arrow_schema(self.target)
        arrays = []
        for f in arrow:
            values = columns.get(f.name)
            if values is None:
                arrays.append(pa.nulls(rows, f.type))
            elif isinstance(values, list):
                arrays.append(pa.array(values, f.type))
            else:
                arrays.append(values.cast(f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _read_records(path: str, header: TableHeader, low: int, high: int) -> np.ndarray:
    with open_file(path) as handle:
        handle.seek(header.header_bytes + low * header.record_bytes)
        raw = handle.read((high - low) * header.record_bytes)
    rows = len(raw) // header.record_bytes
    whole = np.frombuffer(raw, np.uint8, rows * header.record_bytes)
    return whole.reshape(rows, header.record_bytes)


def _read_shapes(piece: Piece, low: int, high: int, with_wkb: bool) -> dict:
    with open_file(piece.shx) as handle:
        handle.seek(HEADER_BYTES + low * INDEX_ENTRY_BYTES)
        entries = handle.read((high - low) * INDEX_ENTRY_BYTES)
    index = np.frombuffer(entries, ">i4").reshape(-1, 2).astype(np.int64) * 2
    offsets, lengths = index[:, 0], index[:, 1]
    base, end = int(offsets.min()), int((offsets + lengths).max()) + 8
    with open_file(piece.shp) as handle:
        if end - base <= 4 * int(lengths.sum() + 8 * len(lengths)):
            handle.seek(base)
            return _decode_shapes(handle.read(end - base), base, offsets, lengths, with_wkb)
        # Records lie scattered through the file: fetch each on its own, put them together.
        records = []
        for offset, length in index.tolist():
            handle.seek(offset)
            records.append(handle.read(length + 8))
    starts = np.cumsum([0, *map(len, records)])[:-1]
    return _decode_shapes(b"".join(records), 0, starts, lengths, with_wkb)


# --- plan -------------------------------------------------------------------------

SIDECARS = ("shx", "dbf", "cpg", "prj")
ENTRY_SCHEMA = "layer STRING, shp STRING, " + ", ".join(f"{ext} STRING" for ext in SIDECARS)
COLUMN_SCHEMA = "shp STRING, ordinal INT, name STRING, type STRING, width INT, precision INT"
ZONE = "STRUCT<" + ", ".join(f"{c}_{end}: DOUBLE" for c in BOX_COLUMNS for end in ("low", "high")) + ">"
PIECE_SCHEMA = """
    layer STRING, shp STRING, shx STRING, dbf STRING, cpg STRING, low BIGINT, high BIGINT, bytes BIGINT, problem STRING
"""


@dataclass(frozen=True)
class ShapefilePlan:
    """The record ranges of shapefiles and the columns of all of them."""

    plan: Plan
    schema: T.StructType


def _in_tasks(rows_of, ddl: str):
    """A function over Arrow batches that turns each row (a dict) into rows of another table."""
    arrow = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = rows_of(row)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return run


def _entries(row: dict) -> list[dict]:
    """The shapefiles among files of one name, each with its sidecars: of its own spelling before any other."""
    by_lower = {path.lower(): path for path in sorted(row["paths"])}
    known = set(row["paths"])
    found = []
    for shp in sorted(p for p in known if p.lower().endswith(".shp")):
        base = shp[: -len(".shp")]
        entry = {"layer": base.rsplit("/", 1)[-1], "shp": shp}
        for ext in SIDECARS:
            spelled = [p for p in (f"{base}.{ext}", f"{base}.{ext.upper()}") if p in known]
            entry[ext] = spelled[0] if spelled else by_lower.get(f"{base}.{ext}".lower())
        found.append(entry)
    return found


def _single_entry(row: dict) -> list[dict]:
    base = row["path"][: -len(".shp")]
    beside = {ext: _first_readable(base, ext) for ext in SIDECARS}
    return [{"layer": base.rsplit("/", 1)[-1], "shp": row["path"], **beside}]


def shapefile_entries(spark: SparkSession, root: str, layer: str | None = None) -> DataFrame:
    """``layer``, ``shp`` and sidecars of the shapefile at a path or of all below it, found by tasks."""
    if root.lower().rstrip("/").endswith(".shp"):
        named = spark.createDataFrame([(root.rstrip("/"),)], "path string")
        found = named.mapInArrow(_in_tasks(_single_entry, ENTRY_SCHEMA), ENTRY_SCHEMA)
    else:
        path = F.col("path")
        files = shown_files(list_tree(spark, root), root).where(extension(path).isin("shp", *SIDECARS))
        bare = F.lower(F.left(path, F.length(path) - F.length(extension(path))))
        # The files of one name are as many as it has endings and spellings.
        grouped = files.groupBy(bare.alias("bare")).agg(F.collect_set("path").alias("paths"))
        found = grouped.mapInArrow(_in_tasks(_entries, ENTRY_SCHEMA), ENTRY_SCHEMA)
    return found if layer is None else found.where(F.col("layer") == layer)


def _columns_of(row: dict) -> list[dict]:
    fields = _fields_or_none(row["dbf"]) if row["dbf"] else []
    return [
        {"shp": row["shp"], "ordinal": n, "name": name, "type": f.spark_type.json(), "width": f.width, "precision": f.decimals}
        for n, (f, name) in enumerate(zip(fields, column_names(fields), strict=True))
    ]


def attributes_of(entries: DataFrame) -> list[T.StructField]:
    """The attribute columns of all files, in the order of the first file that has each."""
    columns = entries.mapInArrow(_in_tasks(_columns_of, COLUMN_SCHEMA), COLUMN_SCHEMA)
    first = F.min(F.struct("shp", "ordinal", "name")).alias("first")
    kinds = columns.groupBy(F.lower("name").alias("key"), "type").agg(
        first, F.max("width").alias("width"), F.max("precision").alias("precision")
    )
    found: dict[str, T.StructField] = {}
    for row in sorted(kinds.collect(), key=lambda r: r["first"]):  # one row for each column and type
        kind = T._parse_datatype_json_string(row["type"])
        _merged(found, row["first"]["name"], kind, row["width"], row["precision"])
    return list(found.values())


def _cut(row: dict, bytes_per_range: int) -> list[dict]:
    """The record ranges of one shapefile, of like bytes in shapes and attributes together."""
    places = {c: row[c] for c in ("layer", "shp", "shx", "dbf", "cpg")}
    try:
        if row["shx"] is None:
            raise ValueError(NO_INDEX)
        attributes = read_table_header(row["dbf"]).record_bytes if row["dbf"] else 0
        starts, total, at, last = [], 0, 0, -1  # starts: (first record, bytes before it)
        with open_file(row["shx"]) as handle:
            records = max(0, handle.size() - HEADER_BYTES) // INDEX_ENTRY_BYTES
            handle.seek(HEADER_BYTES)
            while at < records:
                raw = handle.read(min(ENTRIES_AT_ONCE, records - at) * INDEX_ENTRY_BYTES)
                words = np.frombuffer(raw, ">i4").reshape(-1, 2)[:, 1].astype(np.int64)
                sizes = 2 * words + RECORD_HEAD_BYTES + INDEX_ENTRY_BYTES + attributes
                before = total + np.cumsum(sizes) - sizes
                place = before // bytes_per_range
                fresh = np.flatnonzero(np.diff(place, prepend=last))
                starts += zip((at + fresh).tolist(), before[fresh].tolist(), strict=True)
                total, at, last = total + int(sizes.sum()), at + len(words), place[-1]
    except (OSError, ValueError, struct.error) as problem:
        return [{**places, "bytes": 0, "problem": str(problem)}]
    ends = [*starts[1:], (records, total)]
    return [
        {**places, "low": low, "high": high, "bytes": end - begin}
        for (low, begin), (high, end) in zip(starts, ends, strict=True)
    ]


def shapefile_plan(
    spark: SparkSession,
    root: str,
    layer: str | None = None,
    bytes_per_share: int = BYTES_PER_SHARE,
    bytes_per_range: int = BYTES_PER_RANGE,
) -> ShapefilePlan:
    """Record ranges and columns of the shapefiles at or below a path. Tasks list, read heads and indexes, and cut."""
    folder = shared_folder(spark, "shapefiles")
    shapefile_entries(spark, root, layer).write.parquet(folder)
    entries = spark.read.schema(ENTRY_SCHEMA).parquet(folder)
    spread = entries.repartition(spark.sparkContext.defaultParallelism, "shp")
    pieces = spread.mapInArrow(_in_tasks(lambda row: _cut(row, bytes_per_range), PIECE_SCHEMA), PIECE_SCHEMA)
    schema = T.StructType(FRONT + attributes_of(spread) + BACK)
    return ShapefilePlan(write_plan(pieces, bytes_per_share), schema)


def _zone(row: dict) -> list[dict]:
    """A range with the least and the greatest of each box column of its records."""
    row = {**row, "zone": None}
    if row["problem"] is None:
        zone = {f"{c}_{end}": None for c in BOX_COLUMNS for end in ("low", "high")}
        piece = Piece(*(row[c] for c in ("layer", "shp", "shx", "dbf", "cpg", "low", "high")))
        try:
            for low in range(piece.low, piece.high, ROWS_PER_BATCH):
                shapes = _read_shapes(piece, low, min(piece.high, low + ROWS_PER_BATCH), False)
                for c in BOX_COLUMNS:
                    values = shapes[c] if isinstance(shapes[c], pa.Array) else pa.array(shapes[c], pa.float64())
                    if pc.any(pc.is_nan(values)).as_py():
                        return [row]  # not a number is above all numbers for a filter
                    span = pc.min_max(values).as_py()
                    for end, known, best in (("low", "min", min), ("high", "max", max)):
                        both = [v for v in (zone[f"{c}_{end}"], span[known]) if v is not None]
                        zone[f"{c}_{end}"] = best(both, default=None)
            row["zone"] = zone
        except (OSError, ValueError, struct.error):
            pass  # no zone: the range is read, and says itself what is wrong
    return [row]


def with_zones(spark: SparkSession, found: ShapefilePlan) -> ShapefilePlan:
    """The plan with the box of every range, from one pass over the shapes. Worth it for layers that are
    asked for parts of their extent more than once."""
    folder = shared_folder(spark, "zones")
    ddl = f"{PIECE_SCHEMA.rstrip()}, share BIGINT, `group` BIGINT, zone {ZONE}"
    rows = spark.read.schema(f"{PIECE_SCHEMA.rstrip()}, share BIGINT, `group` BIGINT").parquet(found.plan.folder)
    spread = rows.repartition(max(1, found.plan.shares), "share")
    zoned = spread.mapInArrow(_in_tasks(_zone, ddl), ddl)
    zoned.repartition("group").write.partitionBy("group").parquet(folder)
    return ShapefilePlan(replace(found.plan, folder=folder), found.schema)


def read_shapefiles(spark: SparkSession, found: ShapefilePlan, columns: list[str] | None = None) -> DataFrame:
    """The features of a plan; ``columns`` leaves out the others, above all ``geometry_wkb``."""
    schema = T.StructType([f for f in found.schema if columns is None or f.name in columns])
    return spark.read.format("shapefile").schema(schema).options(**found.plan.options()).load()


def open_shapefiles(
    spark: SparkSession, root: str, layer: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """The features of the shapefiles at or below a path, or of the one called ``layer``."""
    return read_shapefiles(spark, shapefile_plan(spark, root, layer), columns)


# --- headers ----------------------------------------------------------------------

HEADER_SCHEMA = """
    path STRING, shape_type INT, feature_count BIGINT, wkt STRING, error STRING,
    extent STRUCT<xmin: DOUBLE, xmax: DOUBLE, ymin: DOUBLE, ymax: DOUBLE>,
    fields ARRAY<STRUCT<ordinal: INT, name: STRING, alias: STRING, type: STRING,
                        width: INT, precision: INT, nullable: BOOLEAN>>
"""


def _read_header(entry: dict) -> dict:
    with open_file(entry["shp"]) as handle:
        head = handle.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES or struct.unpack_from(">i", head)[0] != 9994:
        raise ValueError("not a shapefile")
    if entry["shx"] is None:
        raise ValueError(NO_INDEX)
    with open_file(entry["shx"]) as handle:
        count = max(0, handle.size() - HEADER_BYTES) // INDEX_ENTRY_BYTES
    xmin, ymin, xmax, ymax = struct.unpack_from("<4d", head, 36)
    wkt = None
    if entry["prj"]:
        with open_file(entry["prj"]) as handle:
            wkt = handle.read().decode("utf-8", "replace").strip()
    return {
        "path": entry["shp"],
        "shape_type": struct.unpack_from("<i", head, 32)[0],
        "feature_count": count,
        "wkt": wkt,
        "extent": {"xmin": xmin, "xmax": xmax, "ymin": ymin, "ymax": ymax} if count > 0 else None,
        "fields": [
            {
                "ordinal": i,
                "name": f.name,
                "alias": "",
                "type": f.type_name,
                "width": f.width,
                "precision": f.decimals,
                "nullable": True,
            }
            for i, f in enumerate(read_table_header(entry["dbf"]).fields if entry["dbf"] else [], start=1)
        ],
    }


def _header_or_problem(entry: dict) -> list[dict]:
    try:
        return [_read_header(entry)]
    except (OSError, ValueError, struct.error) as problem:
        return [{"path": entry["shp"], "error": f"Could not open shapefile: {problem}"}]


def shapefile_headers(spark: SparkSession, root: str) -> DataFrame:
    """One row per shapefile at or below a path: type, count, extent, system, fields, error.

    Headers are read by the tasks that hold the listing; no record is touched.
    """
    entries = shapefile_entries(spark, root).repartition(spark.sparkContext.defaultParallelism, "shp")
    headers = entries.mapInArrow(_in_tasks(_header_or_problem, HEADER_SCHEMA), HEADER_SCHEMA)
    wkt = F.col("wkt")
    return headers.select(
        stem(F.col("path")).alias("layer"),
        "path",
        F.when(F.col("error").isNull(), layer_geometry_type(F.col("shape_type"))).alias("geometry_type"),
        "feature_count",
        "extent",
        wkt_label(wkt).alias("crs"),
        F.size("fields").alias("field_count"),
        "fields",
        "error",
    )
