"""TIFF rasters as a Spark source.

``raster_pixels(spark, path)`` gives the pixels of every raster at or below a path as
``(path, band, row, col, value)``. Tasks read the headers and plan: they cut the blocks (strips or
tiles) of a file into shares of like bytes. What is cut and read at a time is a *segment*: whole rows of a
block that isn't compressed, so that a raster of one large strip has many; or a compressed
block, which is inflated a few rows at a time. No block is ever held whole.
``spark.read.format("raster").load(path)`` does the same for one file or a small folder without
a plan; it then shares out files by size alone.

With ``mode=parts`` a task returns one row per band of its share instead: count, minimum,
maximum, mean and squared deviations of its pixels. ``raster_band_stats`` merges those, so
statistics over a huge raster shuffle a few rows rather than its pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from layerscan.functions.crs import crs_label
from layerscan.functions.paths import RASTER_EXTENSIONS, extension, stem
from layerscan.functions.raster import cell_size, raster_extent
from layerscan.operators.profile import merge_band_parts
from layerscan.sources.discovery import list_tree, shown_files
from layerscan.sources.files import list_sizes, open_file, path_exists
from layerscan.sources.shares import BYTES_PER_SHARE, Plan, Share, cut_points, planned, share_rows, task_shares, write_plan

BYTES_PER_PARTITION = BYTES_PER_SHARE
PIXELS_PER_BATCH = 1 << 18
#: Bytes of samples that a task holds at a time, and of compressed data.
SEGMENT_BYTES = 4 << 20
INFLATE_BYTES = 1 << 20

# Tag numbers of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
EXTRA_SAMPLES, SAMPLE_FORMAT = 338, 339
PIXEL_SCALE, TIE_POINTS, TRANSFORM = 33550, 33922, 34264
GEO_KEYS, GEO_TEXTS, NODATA = 34735, 34737, 42113

# Geographic keys.
RASTER_TYPE, CITATION, GEOGRAPHIC_CODE, GEOGRAPHIC_CITATION = 1025, 1026, 2048, 2049
ANGULAR_UNIT, PROJECTED_CODE, PROJECTED_CITATION, LINEAR_UNIT = 2054, 3072, 3073, 3076

# Names of codes.
COMPRESSIONS = {1: "none", 2: "CCITT", 5: "LZW", 6: "JPEG", 7: "JPEG", 8: "deflate", 32773: "PackBits",
                32946: "deflate", 34925: "LZMA", 50000: "ZSTD"}
UNIT_NAMES = {9001: "metre", 9002: "foot", 9003: "US survey foot", 9101: "radian", 9102: "degree"}
CRS_NAMES = {4326: "WGS 84", 4269: "NAD83", 4258: "ETRS89", 3857: "WGS 84 / Pseudo-Mercator"}
# First code, number of codes, base name and hemisphere of UTM zones.
UTM_RANGES = [(32601, 60, "WGS 84", "N"), (32701, 60, "WGS 84", "S"), (25828, 11, "ETRS89", "N"),
              (26901, 23, "NAD83", "N")]

# Type name and numpy code by (sample format, bits per sample).
SAMPLE_TYPES = {
    (1, 8): ("Byte", "u1"),
    (1, 16): ("UInt16", "u2"),
    (1, 32): ("UInt32", "u4"),
    (1, 64): ("UInt64", "u8"),
    (2, 8): ("Int8", "i1"),
    (2, 16): ("Int16", "i2"),
    (2, 32): ("Int32", "i4"),
    (2, 64): ("Int64", "i8"),
    (3, 32): ("Float32", "f4"),
    (3, 64): ("Float64", "f8"),
}

# Struct code and size of each tag value type.
TAG_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1),
             8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4),
             16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


def _read_tags(handle) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image in a file, classic or big."""
    order = {b"II": "<", b"MM": ">"}.get(handle.read(2))
    if order is None:
        raise ValueError("not a TIFF file")
    (version,) = struct.unpack(order + "H", handle.read(2))
    big = version == 43
    if not big and version != 42:
        raise ValueError("not a TIFF file")
    word, inline, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    if big:
        handle.read(4)
    (start,) = struct.unpack(order + word, handle.read(inline))
    handle.seek(start)
    (count,) = struct.unpack(order + ("Q" if big else "H"), handle.read(8 if big else 2))
    table, tags = handle.read(count * entry), {}
    for at in range(0, len(table) - entry + 1, entry):
        tag, kind = struct.unpack_from(order + "HH", table, at)
        (items,) = struct.unpack_from(order + word, table, at + 4)
        if kind not in TAG_TYPES:
            continue
        code, size = TAG_TYPES[kind]
        raw = table[at + entry - inline : at + entry]
        if items * size > inline:
            (offset,) = struct.unpack(order + word, raw)
            handle.seek(offset)
            raw = handle.read(items * size)
        if kind == 2:
            tags[tag] = (raw[:items].split(b"\0")[0].decode("latin-1"),)
        else:
            tags[tag] = struct.unpack_from(order + code * items if len(code) > 1 else f"{order}{items}{code}", raw)
    return order, tags


@dataclass(frozen=True)
class Raster:
    """What the header of one TIFF says."""

    order: str
    tags: dict[int, tuple] = field(repr=False)
    segment_bytes: int = SEGMENT_BYTES

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def columns(self) -> int:
        return self.one(WIDTH)

    @property
    def rows(self) -> int:
        return self.one(HEIGHT)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def tiled(self) -> bool:
        return TILE_WIDTH in self.tags

    @property
    def block(self) -> tuple[int, int]:
        """Block width and height."""
        if self.tiled:
            return self.one(TILE_WIDTH), self.one(TILE_HEIGHT)
        return self.columns, min(self.one(ROWS_PER_STRIP, self.rows), self.rows)

    @property
    def separate(self) -> bool:
        """Each block holds one band only."""
        return self.one(PLANAR, 1) == 2 and self.bands > 1

    @property
    def grid(self) -> tuple[int, int]:
        """Blocks across and down."""
        width, height = self.block
        return -(-self.columns // width), -(-self.rows // height)

    @property
    def block_count(self) -> int:
        across, down = self.grid
        return across * down * (self.bands if self.separate else 1)

    @property
    def compressed(self) -> bool:
        return self.one(COMPRESSION, 1) != 1

    @property
    def row_bytes(self) -> int:
        """Bytes of one row of a block, when inflated."""
        return self.block[0] * (1 if self.separate else self.bands) * self.one(BITS, 1) // 8

    @property
    def segment_rows(self) -> int:
        """Rows of a block that are held at a time."""
        return max(1, min(self.block[1], self.segment_bytes // max(1, self.row_bytes)))

    @property
    def segments_per_block(self) -> int:
        """A compressed block can only be read from its start."""
        return 1 if self.compressed else -(-self.block[1] // self.segment_rows)

    @property
    def segment_count(self) -> int:
        return self.block_count * self.segments_per_block

    def segment_sizes(self) -> np.ndarray:
        """Stored bytes of each segment, about."""
        sizes = np.array(self.tags[TILE_BYTES if self.tiled else STRIP_BYTES][: self.block_count], np.int64)
        return np.repeat(sizes // self.segments_per_block, self.segments_per_block)

    @property
    def sample(self) -> tuple[str, str | None]:
        """Type name and numpy code of a sample."""
        key = (self.one(SAMPLE_FORMAT, 1), self.one(BITS, 1))
        return SAMPLE_TYPES.get(key, (f"{key[1]}-bit", None))

    @property
    def nodata(self) -> float | None:
        text = self.one(NODATA)
        try:
            return float(text)
        except (TypeError, ValueError):
            return None

    @property
    def problem(self) -> str | None:
        """Why the pixels cannot be decoded; None when they can."""
        method = self.one(COMPRESSION, 1)
        if method not in (1, 8, 32946):
            return f"Unsupported compression: {COMPRESSIONS.get(method, method)}"
        if self.sample[1] is None or len(set(self.tags.get(BITS, (1,)))) > 1:
            return f"Unsupported sample type: {self.sample[0]}"
        allowed = (1, 3) if self.sample[1].startswith("f") else (1, 2)
        if self.one(PREDICTOR, 1) not in allowed:
            return f"Unsupported predictor: {self.one(PREDICTOR)}"
        return None

    @property
    def transform(self) -> tuple[float, float, float, float]:
        """Origin x, step x, origin y, step y; the identity without georeference."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            origin_x, step_x, origin_y, step_y = m[3], m[0], m[7], m[5]
        elif PIXEL_SCALE in self.tags and TIE_POINTS in self.tags:
            scale, tie = self.tags[PIXEL_SCALE], self.tags[TIE_POINTS]
            step_x, step_y = scale[0], -scale[1]
            origin_x, origin_y = tie[3] - tie[0] * step_x, tie[4] - tie[1] * step_y
        else:
            return 0.0, 1.0, 0.0, 1.0
        if self.geo_keys.get(RASTER_TYPE) == 2:
            # Coordinates name pixel centres: move to the corner.
            origin_x, origin_y = origin_x - step_x / 2, origin_y - step_y / 2
        return origin_x, step_x, origin_y, step_y

    @property
    def geo_keys(self) -> dict[int, int | str]:
        shorts, texts, keys = self.tags.get(GEO_KEYS, ()), self.one(GEO_TEXTS, ""), {}
        for at in range(4, len(shorts) - 3, 4):
            key, place, length, value = shorts[at : at + 4]
            if place == 0:
                keys[key] = value
            elif place == GEO_TEXTS:
                keys[key] = texts[value : value + length].rstrip("|").strip()
        return keys

    @property
    def crs(self) -> tuple[str | None, str | None, str | None, str | None]:
        """Code, name, linear unit, angular unit."""
        keys = self.geo_keys
        if PROJECTED_CODE in keys or PROJECTED_CITATION in keys:
            code, cited = keys.get(PROJECTED_CODE), keys.get(PROJECTED_CITATION)
            units = UNIT_NAMES.get(keys.get(LINEAR_UNIT, 9001)), None
        elif GEOGRAPHIC_CODE in keys or GEOGRAPHIC_CITATION in keys:
            code, cited = keys.get(GEOGRAPHIC_CODE), keys.get(GEOGRAPHIC_CITATION)
            units = None, UNIT_NAMES.get(keys.get(ANGULAR_UNIT, 9102))
        else:
            return None, None, None, None
        code = None if code in (None, 0, 32767) else code
        name = _crs_name(code) or cited or keys.get(CITATION) or "unknown"
        return None if code is None else str(code), name, *units

    def color(self, band: int) -> str:
        """Colour role of a band."""
        roles = {0: ["Gray"], 1: ["Gray"], 2: ["Red", "Green", "Blue"], 3: ["Palette"],
                 5: ["Cyan", "Magenta", "Yellow", "Black"]}.get(self.one(PHOTOMETRIC, 1), ["Undefined"])
        if band <= len(roles):
            return roles[band - 1]
        extra = self.tags.get(EXTRA_SAMPLES, ())
        place = band - 1 - (self.bands - len(extra))
        return "Alpha" if 0 <= place < len(extra) and extra[place] in (1, 2) else "Undefined"


def _crs_name(code: int | None) -> str | None:
    for first, zones, base, half in UTM_RANGES:
        if code is not None and first <= code < first + zones:
            return f"{base} / UTM zone {code % 100}{half}"
    return CRS_NAMES.get(code)


def read_raster_header(handle, segment_bytes: int = SEGMENT_BYTES) -> Raster:
    raster = Raster(*_read_tags(handle), segment_bytes)
    if not raster.columns or not raster.rows:
        raise ValueError("image size is missing")
    return raster


def read_segment(handle, raster: Raster, index: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First band, first row, first column and samples ``(height, width, bands)`` of the parts of a segment."""
    block, part = divmod(index, raster.segments_per_block)
    across, down = raster.grid
    width, height = raster.block
    first_band, place = divmod(block, across * down) if raster.separate else (0, block)
    top, left = (place // across) * height, (place % across) * width
    depth = 1 if raster.separate else raster.bands
    stored = height if raster.tiled else min(height, raster.rows - top)
    offsets, sizes = (TILE_OFFSETS, TILE_BYTES) if raster.tiled else (STRIP_OFFSETS, STRIP_BYTES)
    offset, size = raster.tags[offsets][block], raster.tags[sizes][block]
    dtype = np.dtype(raster.order + raster.sample[1])
    step = raster.segment_rows
    # One part of a block that isn't compressed; all parts of one that is.
    starts = range(0, stored, step) if raster.compressed else range(part * step, min(stored, part * step + step), step)
    counts = [min(step, stored - at) for at in starts]
    if offset == 0 and size == 0:
        pieces = None  # a block left out of the file holds nodata throughout
    elif raster.compressed:
        pieces = _inflated(handle, offset, size, [n * raster.row_bytes for n in counts])
    else:
        pieces = _plain(handle, offset, size, raster.row_bytes, starts, counts)
    for at, rows in zip(starts, counts, strict=True):
        if top + at >= raster.rows:
            break  # a tile reaches over the lower edge
        shape = (rows, width, depth)
        if pieces is None:
            samples = np.full(shape, raster.nodata or 0, dtype)
        else:
            samples = _samples(next(pieces), shape, dtype, raster.one(PREDICTOR, 1))
        yield first_band + 1, top + at, left, samples[: raster.rows - top - at, : raster.columns - left]


def _plain(handle, offset: int, size: int, row_bytes: int, starts, counts: list[int]) -> Iterator[bytes]:
    for at, rows in zip(starts, counts, strict=True):
        handle.seek(offset + at * row_bytes)
        yield handle.read(max(0, min(rows * row_bytes, size - at * row_bytes)))


def _inflated(handle, offset: int, size: int, wanted: list[int]) -> Iterator[bytes]:
    """Parts of so many bytes of a compressed block, one after the other."""
    inflater, waiting, end = zlib.decompressobj(), b"", offset + size
    for count in wanted:
        part = bytearray()
        while len(part) < count and not inflater.eof:
            if not waiting:
                handle.seek(offset)
                waiting = handle.read(min(INFLATE_BYTES, end - offset))
                offset += len(waiting)
            more = inflater.decompress(waiting, count - len(part))
            if not more and not waiting:
                raise ValueError("a compressed block ends early")
            part += more
            waiting = inflater.unconsumed_tail
        yield bytes(part)


def _samples(data: bytes, shape: tuple[int, int, int], dtype: np.dtype, predictor: int) -> np.ndarray:
    height, width, depth = shape
    if predictor == 3:
        return _undo_float_predictor(data, shape, dtype)
    samples = np.frombuffer(data, dtype, height * width * depth).reshape(shape)
    if predictor == 2:
        return np.cumsum(samples, axis=1, dtype=dtype.newbyteorder("="))
    return samples


def _undo_float_predictor(data: bytes, shape: tuple[int, int, int], dtype: np.dtype) -> np.ndarray:
    """Floats stored line by line as planes of bytes, highest byte first, each byte as the
    difference from the one before it in its band."""
    height, width, depth = shape
    size = dtype.itemsize
    raw = np.frombuffer(data, np.uint8, height * width * depth * size)
    planes = np.cumsum(raw.reshape(height, size * width, depth), axis=1, dtype=np.uint8)
    joined = planes.reshape(height, size, width * depth).transpose(0, 2, 1)
    return np.ascontiguousarray(joined).view(f">f{size}").reshape(shape)


# --- source -----------------------------------------------------------------------

PIXEL_SCHEMA = "path STRING, band INT, row INT, col INT, value DOUBLE, nodata DOUBLE, error STRING"
PART_SCHEMA = """
    path STRING, band INT, valid BIGINT, min DOUBLE, max DOUBLE, mean DOUBLE, m2 DOUBLE,
    nodata DOUBLE, error STRING
"""
PIECE_SCHEMA = "path STRING, first BIGINT, last BIGINT, bytes BIGINT, segment_bytes BIGINT, problem STRING"
MISSING = "No such file"


class FileShares(InputPartition):
    """Shares ``(path, share, of)`` of the segments of files."""

    def __init__(self, shares: list[tuple[str, int, int]]):
        super().__init__(None)
        self.shares = shares


class RasterSource(DataSource):
    """Pixels, or partial band statistics, of TIFF files."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return PART_SCHEMA if self.options.get("mode") == "parts" else PIXEL_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RasterReader(schema, dict(self.options))


class RasterReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.arrow = to_arrow_schema(schema)
        self.path = options.get("path")
        self.plan = planned(options)
        self.parts = options.get("mode") == "parts"
        self.bytes_per_partition = int(options.get("bytesperpartition", BYTES_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        """The shares of the plan; without one, share out large files and put small ones together, by size."""
        if self.plan:
            return task_shares(self.plan)
        endings = tuple(f".{e}" for e in RASTER_EXTENSIONS)
        files = {p: s for p, s in list_sizes(self.path).items() if p.lower().endswith(endings)}
        groups, group, filled = [], [], 0
        for path, size in sorted(files.items()):
            shares = max(1, -(-size // self.bytes_per_partition))
            if shares > 1:
                groups += [FileShares([(path, i, shares)]) for i in range(shares)]
                continue
            if group and filled + size > self.bytes_per_partition:
                groups.append(FileShares(group))
                group, filled = [], 0
            group.append((path, 0, 1))
            filled += size
        if group or not groups:
            groups.append(FileShares(group if files else [(self.path, 0, 1)]))
        return groups

    def _ranges(self, partition: InputPartition) -> Iterator[tuple]:
        """Path, problem, bytes of a segment, and the first and last segment as functions of their number."""
        if isinstance(partition, Share):
            for piece in share_rows(self.plan, partition.first, partition.last):
                bounds = lambda _, p=piece: (p["first"], p["last"])
                yield piece["path"], piece["problem"], piece["segment_bytes"], bounds
        else:
            for path, share, of in partition.shares:
                yield path, None, SEGMENT_BYTES, lambda n, i=share, of=of: (n * i // of, n * (i + 1) // of)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, problem, segment_bytes, bounds in self._ranges(partition):
            try:
                if problem:
                    raise ValueError(problem)
                with open_file(path) as handle:
                    raster = read_raster_header(handle, segment_bytes)
                    if raster.problem:
                        raise ValueError(raster.problem)
                    segments = range(*bounds(raster.segment_count))
                    parts = (part for i in segments for part in read_segment(handle, raster, i))
                    make = self._part_rows if self.parts else self._pixel_rows
                    yield from make(path, raster, parts)
            except FileNotFoundError:
                yield self._error(path, MISSING)
            except (OSError, ValueError, KeyError, IndexError, struct.error, zlib.error) as problem:
                yield self._error(path, str(problem))

    def _error(self, path: str, problem: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "error": problem}], schema=self.arrow)

    def _pixel_rows(self, path, raster, blocks) -> Iterator[pa.RecordBatch]:
        for first_band, top, left, samples in blocks:
            height, width, depth = samples.shape
            step = max(1, PIXELS_PER_BATCH // max(1, width * depth))
            for start in range(0, height, step):
                part = samples[start : start + step]
                rows, cols, bands = np.indices(part.shape, dtype=np.int32)
                size = part.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(path, size),
                        pa.array((bands + first_band).ravel()),
                        pa.array((rows + top + start).ravel()),
                        pa.array((cols + left).ravel()),
                        pa.array(part.astype(np.float64).ravel()),
                        pa.repeat(pa.scalar(_as_sample(raster.nodata, part.dtype), pa.float64()), size),
                        pa.nulls(size, pa.string()),
                    ],
                    schema=self.arrow,
                )

    def _part_rows(self, path, raster, blocks) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for first_band, _, _, samples in blocks:
            for depth in range(samples.shape[2]):
                values = samples[:, :, depth].astype(np.float64).ravel()
                usable = ~np.isnan(values)
                if raster.nodata is not None:
                    usable &= values != _as_sample(raster.nodata, samples.dtype)
                values = values[usable]
                total = totals.setdefault(first_band + depth, [0, None, None, 0.0, 0.0])
                if values.size:
                    _add_block(total, values)
        rows = [
            {
                "path": path,
                "band": band,
                "valid": n,
                "min": low,
                "max": high,
                "mean": mean if n else None,
                "m2": m2 if n else None,
                "nodata": raster.nodata,
            }
            for band, (n, low, high, mean, m2) in sorted(totals.items())
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


def _as_sample(nodata: float | None, dtype: np.dtype) -> float | None:
    """The nodata value as a pixel of that type holds it."""
    return nodata if nodata is None or dtype.kind != "f" else float(dtype.type(nodata))


def _add_block(total: list, values: np.ndarray) -> None:
    """Merge the values of a part of a block into ``[count, min, max, mean, m2]``."""
    n, low, high, mean, m2 = total
    block_mean = float(values.mean())
    gap, both = block_mean - mean, n + values.size
    total[:] = [
        both,
        float(values.min()) if low is None else min(low, float(values.min())),
        float(values.max()) if high is None else max(high, float(values.max())),
        mean + gap * values.size / both,
        m2 + float(((values - block_mean) ** 2).sum()) + gap * gap * n * values.size / both,
    ]


def _plan_files(bytes_per_share: int, segment_bytes: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = _file_pieces(path, bytes_per_share, segment_bytes)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _file_pieces(path: str, bytes_per_share: int, segment_bytes: int) -> list[dict]:
    """The ranges of segments of a file, of like bytes; or one that says why there are none."""
    try:
        with open_file(path) as handle:
            raster = read_raster_header(handle, segment_bytes)
        if raster.problem:
            raise ValueError(raster.problem)
        firsts, sizes = cut_points(raster.segment_sizes(), bytes_per_share)
    except FileNotFoundError:
        return [{"path": path, "bytes": 0, "problem": MISSING}]
    except (OSError, ValueError, KeyError, struct.error) as problem:
        return [{"path": path, "bytes": 0, "problem": str(problem)}]
    lasts = [*firsts[1:].tolist(), raster.segment_count]
    ranges = zip(firsts.tolist(), lasts, sizes.tolist(), strict=True)
    return [
        {"path": path, "first": a, "last": b, "bytes": size, "segment_bytes": segment_bytes} for a, b, size in ranges
    ]


def raster_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the rasters at or below a path, listed by tasks; of a missing path, the path itself."""
    files = shown_files(list_tree(spark, root), root)
    named = files.where(extension(F.col("path")).isin(RASTER_EXTENSIONS)).select("path")
    return spark.createDataFrame([(root,)], "path string") if not path_exists(root) else named


def raster_plan(
    spark: SparkSession, root: str, bytes_per_share: int = BYTES_PER_SHARE, segment_bytes: int = SEGMENT_BYTES
) -> Plan:
    """Shares of like bytes of all rasters at or below a path. Tasks list, read headers and cut."""
    arrow = to_arrow_schema(T.StructType.fromDDL(PIECE_SCHEMA))
    paths = raster_files(spark, root).repartition(spark.sparkContext.defaultParallelism, "path")
    return write_plan(paths.mapInArrow(_plan_files(bytes_per_share, segment_bytes, arrow), PIECE_SCHEMA), bytes_per_share)


def raster_pixels(spark: SparkSession, path: str, plan: Plan | None = None) -> DataFrame:
    """Every pixel of the rasters at or below a path; an unreadable file has a row with an ``error``."""
    plan = plan or raster_plan(spark, path)
    return spark.read.format("raster").options(**plan.options()).load()


def raster_band_stats(
    spark: SparkSession, path: str, by: list[str] | None = None, plan: Plan | None = None
) -> DataFrame:
    """Exact band statistics of all rasters at or below a path; an unreadable file has no
    band but an ``error``."""
    plan = plan or raster_plan(spark, path)
    parts = spark.read.format("raster").options(mode="parts", **plan.options()).load()
    return merge_band_parts(parts, by or ["path", "band"])


# --- headers ----------------------------------------------------------------------

HEADER_SCHEMA = """
    path STRING, driver STRING, columns INT, rows INT, band_count INT, band INT,
    data_type STRING, nodata DOUBLE, color_interp STRING, block_x INT, block_y INT,
    origin_x DOUBLE, step_x DOUBLE, origin_y DOUBLE, step_y DOUBLE,
    crs_code STRING, crs_name STRING, linear_unit STRING, angular_unit STRING, error STRING
"""


def _header_rows(path: str) -> list[dict]:
    with open_file(path) as handle:
        raster = read_raster_header(handle)
    names = ("origin_x", "step_x", "origin_y", "step_y", "crs_code", "crs_name", "linear_unit", "angular_unit")
    common = {
        "path": path,
        "driver": "GTiff",
        "columns": raster.columns,
        "rows": raster.rows,
        "band_count": raster.bands,
        "data_type": raster.sample[0],
        "nodata": raster.nodata,
        "block_x": raster.block[0],
        "block_y": raster.block[1],
        **dict(zip(names, (*raster.transform, *raster.crs), strict=True)),
        "error": raster.problem,
    }
    return [{**common, "band": b, "color_interp": raster.color(b)} for b in range(1, raster.bands + 1)]


def _read_headers(arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    rows += _header_rows(path)
                except (OSError, ValueError, struct.error) as problem:
                    rows.append({"path": path, "error": f"Could not open raster dataset: {problem}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def raster_headers(spark: SparkSession, root: str) -> DataFrame:
    """One row per band of every raster at or below a path, read from headers alone.

    A raster whose pixels cannot be decoded keeps its row and says why in ``error``.
    """
    listed = raster_files(spark, root).repartition(spark.sparkContext.defaultParallelism, "path")
    arrow = to_arrow_schema(T.StructType.fromDDL(HEADER_SCHEMA))
    return (
        listed.mapInArrow(_read_headers(arrow), HEADER_SCHEMA)
        .withColumn("layer", stem(F.col("path")))
    )


def band_schema(headers: DataFrame) -> DataFrame:
    """Band table: type, nodata, colour role and block size."""
    return headers.select(
        "layer", "path", "driver", "columns", "rows", "band_count", "band", "data_type", "nodata",
        "color_interp", F.concat_ws("x", "block_x", "block_y").alias("block_size"), "error",
    )


def raster_geometry(headers: DataFrame) -> DataFrame:
    """One row per raster: size, cells, origin, extent and coordinate system."""
    whole = headers.where(F.col("band").isNull() | (F.col("band") == 1))

    def c(name: str) -> Column:
        return F.col(name)

    return whole.select(
        "layer", "path", "columns", "rows", "band_count",
        cell_size(c("step_x")).alias("cell_size_x"),
        cell_size(c("step_y")).alias("cell_size_y"),
        "origin_x", "origin_y",
        raster_extent(c("origin_x"), c("step_x"), c("origin_y"), c("step_y"), c("columns"), c("rows")).alias("extent"),
        crs_label(c("crs_code"), c("crs_name")).alias("crs"),
        "linear_unit", "angular_unit", "driver", "error",
    )
