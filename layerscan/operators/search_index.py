"""A filter of character sequences for each file of a layer, for searches that are made again and again.

The filter is a bitmap: the hashes of all runs of one, two and three characters of lower-cased cells.
A cell that contains a query contains every run of the query, so rows whose bitmap lacks
one of them have no match. There is one bitmap for each file and task that read it, of a fixed size. A file of which
one bitmap holds the whole query is searched as ever; the filter never changes a result, it only leaves files out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.text import cell_text
from layerscan.operators.search import search_rows

BITS = 18
LONGEST_RUN = 3
#: Characters hashed at once.
BLOCK = 1 << 20
#: Files that a search is cut down to by name, at most; with more the whole layer is searched.
NAMED_FILES = 10_000

_FILTER = "file STRING, bitmap BINARY"


def run_bits(text: str) -> np.ndarray:
    """The bits of the runs of one to three characters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, rolled = [], np.zeros(len(codes) + 1, np.uint64)
    for length in range(1, LONGEST_RUN + 1):
        if len(codes) < length:
            break
        rolled = rolled[:-1] * np.uint64(0x110001) + codes[length - 1 :]
        mixed = (rolled + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(mixed >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[str, np.ndarray] = {}
    for batch in batches:
        cells: dict[str, list[str]] = {}
        for file, texts in zip(batch["file"].to_pylist(), batch["texts"].to_pylist(), strict=True):
            cells.setdefault(file, []).extend(t for t in texts if t)
        for file, texts in cells.items():
            held = maps.setdefault(file, np.zeros(1 << BITS, bool))
            text = "\n".join(texts)  # runs over the end of a cell only add bits
            for at in range(0, len(text), BLOCK):
                held[run_bits(text[at : at + BLOCK + LONGEST_RUN - 1])] = True
    for file, held in maps.items():
        row = [pa.array([file]), pa.array([np.packbits(held).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["file", "bitmap"])


def _texts(df: DataFrame, columns: list[str] | None) -> Column:
    kept = [f for f in df.schema.fields if (columns is None or f.name in columns) and not isinstance(f.dataType, T.BinaryType)]
    return F.array(*[F.lower(cell_text(F.col(f"`{f.name}`"), f.dataType)) for f in kept])


def build_index(rows: DataFrame, index: str, columns: list[str] | None = None) -> None:
    """Write the filters of the files that ``rows`` (a plain scan of files) reads to ``index``. Rows do not move."""
    cells = rows.select(F.col("_metadata.file_path").alias("file"), _texts(rows, columns).alias("texts"))
    cells.mapInArrow(_bitmaps, _FILTER).write.parquet(index)


def files_that_may_match(spark: SparkSession, index: str, query: str) -> DataFrame:
    """``file`` of the files of which a bitmap has every run of the query."""
    wanted = np.unique(run_bits(spark.range(1).select(F.lower(F.lit(query))).first()[0]))

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [
                bool((np.frombuffer(b.as_buffer(), np.uint8)[wanted >> 3] >> (7 - (wanted & 7)) & 1).all())
                for b in batch["bitmap"]
            ]
            yield batch.select(["file"]).filter(pa.array(held, pa.bool_()))

    return spark.read.schema(_FILTER).parquet(index).mapInArrow(matching, "file STRING").distinct()


def search_indexed(rows: DataFrame, index: str, query: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of :func:`search_rows`, read from the files that may have any."""
    if not query:
        return search_rows(rows, query, columns)
    found = files_that_may_match(rows.sparkSession, index, query).limit(NAMED_FILES + 1)
    files = [r["file"] for r in found.collect()]
    if len(files) <= NAMED_FILES:
        rows = rows.where(F.col("_metadata.file_path").isin(files))
    return search_rows(rows, query, columns)
