"""Tables written as shapefiles and TIFFs.

These writers exist to check the file sources against tables of known content. Tasks
write one file per Arrow batch, named after the first key in it, so that a repeated task
writes the same files again.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from layerscan.sources.files import filesystem

WGS84_WKT = (
    'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],'
    'PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
)


def dbf_bytes(columns: list[tuple[str, str, int, int]], rows: list[list[str]], deleted=()) -> bytes:
    """An attribute table; values come as text already, None gives blanks. What doesn't fit is an error."""
    record = 1 + sum(width for _, _, width, _ in columns)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(columns), record)
    for name, kind, width, decimals in columns:
        if len(name.encode()) > 10 or width > 254:
            raise ValueError(f"{name}: a name has at most 10 bytes, a value 254")
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, decimals)
    body = bytearray()
    for place, row in enumerate(rows):
        body += b"*" if place in deleted else b" "
        for (name, kind, width, _), value in zip(columns, row, strict=True):
            text = ("" if value is None else value).encode()
            if len(text) > width:
                raise ValueError(f"{name}: {value} has more than {width} bytes")
            body += text.rjust(width) if kind in "NF" else text.ljust(width)
    return head + b"\r" + bytes(body) + b"\x1a"


def shape_bytes(code: int, contents: list[bytes], box: tuple[float, float, float, float]) -> tuple[bytes, bytes]:
    """Main and index file of records with the given contents; box is xmin, ymin, xmax, ymax."""
    main, index, offset = [], [], 50
    for number, content in enumerate(contents, start=1):
        words = len(content) // 2
        main.append(struct.pack(">2i", number, words) + content)
        index.append(struct.pack(">2i", offset, words))
        offset += 4 + words

    def head(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0)

    body, table = b"".join(main), b"".join(index)
    return head(offset) + body, head(50 + len(table) // 2) + table


def point_bytes(x: float | None, y: float | None) -> bytes:
    return struct.pack("<i", 0) if x is None or y is None else struct.pack("<i2d", 1, x, y)


def polygon_bytes(rings: list[list[tuple[float, float]]]) -> tuple[bytes, tuple[float, float, float, float]]:
    """A polygon's record and its box."""
    points = np.concatenate([np.array(ring, "<f8") for ring in rings])
    box = (*points.min(0).tolist(), *points.max(0).tolist())
    starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
    head = struct.pack("<i4d2i", 5, *box, len(rings), len(points))
    return head + starts.tobytes() + points.tobytes(), box


def tiff_bytes(pixels: np.ndarray, rows_per_strip: int, nodata: str | None = None,
               transform: tuple[float, float, float, float] | None = None, epsg: int | None = None) -> bytes:
    """An uncompressed image ``(rows, columns, bands)`` in strips, bands side by side."""
    rows, columns, bands = pixels.shape
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    bits = pixels.dtype.itemsize * 8
    strips = [pixels[r : r + rows_per_strip].tobytes() for r in range(0, rows, rows_per_strip)]
    offsets = np.cumsum([8, *map(len, strips)])[:-1].tolist()
    tags: list[tuple[int, str, tuple]] = [
        (256, "I", (columns,)), (257, "I", (rows,)), (258, "H", (bits,) * bands), (259, "H", (1,)),
        (262, "H", (1,)), (273, "I", tuple(offsets)), (277, "H", (bands,)), (278, "I", (rows_per_strip,)),
        (279, "I", tuple(map(len, strips))), (284, "H", (1,)), (339, "H", (kind,) * bands),
    ]
    if transform:
        x, step_x, y, step_y = transform
        tags += [(33550, "d", (step_x, -step_y, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x, y, 0.0))]
    if epsg:
        key = 2048 if epsg == 4326 else 3072
        tags.append((34735, "H", (1, 1, 0, 2, 1024, 0, 1, 2 if key == 2048 else 1, key, 0, 1, epsg)))
    if nodata is not None:
        tags.append((42113, "s", (nodata.encode() + b"\0",)))
    return tiff_file(tags, strips)


def tiff_file(tags: list[tuple[int, str, tuple]], blocks: list[bytes]) -> bytes:
    """Blocks right after the file header, then the tags, sorted, and their long values."""
    kinds = {"s": 2, "H": 3, "I": 4, "d": 12}
    data = b"".join(blocks)
    data += b"\0" * (len(data) % 2)
    directory = 8 + len(data)
    spill_at = directory + 2 + 12 * len(tags) + 4
    entries, spill = b"", b""
    for tag, code, values in sorted(tags):
        raw = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        count = len(raw) if code == "s" else len(values)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack("<I", spill_at + len(spill))
            spill += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kinds[code], count) + place
    head = struct.pack("<2sHI", b"II", 42, directory)
    return head + data + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + spill


def _write(path: str, data: bytes) -> None:
    fs, inner = filesystem(path)
    partial = f"{inner}.{os.getpid()}.part"
    with fs.open_output_stream(partial) as target:
        target.write(data)
    fs.move(partial, inner)


def _make_folder(path: str) -> None:
    fs, inner = filesystem(path)
    fs.create_dir(inner, recursive=True)


WRITTEN = "path STRING, rows BIGINT"


def _column(name: str, kind: str, values: list) -> tuple[tuple[str, str, int, int], list[str | None]]:
    """A column of an attribute table and its values as text, in a width that holds all of them."""
    if kind == "date":
        texts = [None if v is None else v.strftime("%Y%m%d") for v in values]
        return (name, "D", 8, 0), texts
    texts = [None if v is None else repr(v) if kind == "double" else str(v) for v in values]
    width = max((len(t.encode()) for t in texts if t is not None), default=1) or 1
    if kind in ("int", "bigint"):
        return (name, "N", {"int": 9, "bigint": 18}[kind], 0), texts
    return (name, "N", width, 1) if kind == "double" else (name, "C", width, 0), texts


def _point(row: dict) -> tuple[bytes, tuple | None]:
    x, y = row["x"], row["y"]
    return point_bytes(x, y), None if x is None or y is None else (x, y, x, y)


def _polygon(row: dict) -> tuple[bytes, tuple | None]:
    return polygon_bytes(row["rings"])


def write_shapefiles(df: DataFrame, folder: str, key: str, kind: str = "point", name: str = "part") -> DataFrame:
    """Rows as features with attributes; returns the files written once it is run.

    ``kind`` is ``point`` (columns ``x`` and ``y``, which may be null) or ``polygon`` (``rings``, arrays of points).
    """
    code, shape, given = {"point": (1, _point, ("x", "y")), "polygon": (5, _polygon, ("rings",))}[kind]
    kinds = {column: kind for column, kind in df.dtypes if column not in given}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _make_folder(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, texts = zip(
                *[_column(column, kind, batch.column(column).to_pylist()) for column, kind in kinds.items()], strict=True
            )
            contents, boxes = zip(*map(shape, batch.select(given).to_pylist()), strict=True)
            edges = np.array([b for b in boxes if b] or [(0.0,) * 4])
            box = (*edges[:, :2].min(0).tolist(), *edges[:, 2:].max(0).tolist())
            shp, shx = shape_bytes(code, list(contents), box)
            base = f"{folder}/{name}_{batch.column(key)[0].as_py():012d}"
            _write(base + ".shx", shx)
            _write(base + ".dbf", dbf_bytes(list(columns), [list(r) for r in zip(*texts, strict=True)]))
            _write(base + ".prj", WGS84_WKT.encode())
            _write(base + ".shp", shp)
            yield pa.RecordBatch.from_pylist([{"path": base + ".shp", "rows": batch.num_rows}])

    return df.mapInArrow(write, WRITTEN)


def write_plain_files(df: DataFrame, folder: str) -> DataFrame:
    """A file below ``folder`` for each ``path`` (relative), of ``length`` bytes; returns the files written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/{row['path']}"
                _make_folder(path.rsplit("/", 1)[0])
                _write(path, b"\0" * row["length"])
            yield pa.RecordBatch.from_pylist([{"path": folder, "rows": batch.num_rows}])

    return df.mapInArrow(write, WRITTEN)


def write_array_rasters(
    df: DataFrame, folder: str, key: str, values: str, nodata: str | None = None, sample: str = "<f4",
    rows_per_strip: int | None = 16,
) -> DataFrame:
    """Rows of an array column as image lines of one pixel, one band per element; without
    ``rows_per_strip`` each image is one strip."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _make_folder(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column(key)[0].as_py()
            lists = batch.column(values)
            width = len(lists[0])
            grid = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), 1, width)
            transform = (float(first), 0.5, 1000.0, -2.0)
            path = f"{folder}/image_{first:012d}.tif"
            _write(path, tiff_bytes(grid.astype(sample), rows_per_strip or len(lists), nodata, transform, 32633))
            yield pa.RecordBatch.from_pylist([{"path": path, "rows": len(lists)}])

    return df.select(key, values).mapInArrow(write, WRITTEN)
