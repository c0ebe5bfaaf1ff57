"""Token sequences in framed binary files, with an offset index beside each.

A data file is a run of records. A record is its payload's length (8 bytes, little-endian),
the masked checksum of these 8 bytes (4), the payload, and the payload's masked checksum (4).
A checksum is CRC-32, turned right by 15 bits, plus a constant, modulo 2^32. The payload is one
byte for the size of an id (2 or 4), one byte that is 1 if there is a key, the key (8 bytes,
signed), and the ids, all little-endian.

An index file has 16 bytes for each record: its place in the data file and its number
of ids. It allows reading records in any order, and counting ids without the data.

Rows are dealt to files by ranges of the key, and each task writes under a name of its own.
The table of files, written by Spark, names the one attempt of each task that counts. So a
task may run twice or be lost without harm.
"""

from __future__ import annotations

import random
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerscan.llm.tokens import library_words

#: Fixed values of the format: what is added to a turned checksum, and the layouts.
MASK = 0xA282EAD8
HEAD = "<QI"
KEY = "<BBq"
CHECK = "<I"

#: Bytes of ids handed to Spark at once while reading, and of records put to a file at once.
BATCH_BYTES = 8 << 20
WRITE_BYTES = 1 << 20
#: Records of a file, about.
FILE_RECORDS = 1 << 16

_FILES = "part int, data string, entries string, records long, tokens long"
_RECORDS = "doc_id long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    value = zlib.crc32(data)
    return ((value >> 15 | value << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(CHECK, masked(size)) + payload + struct.pack(CHECK, masked(payload))


def unframe(file, at: int) -> bytes:
    """The payload of the record at a place of a data file; an error if it is damaged."""
    file.seek(at)
    head = file.read(struct.calcsize(HEAD))
    if len(head) < struct.calcsize(HEAD):
        raise ValueError(f"record at {at}: the file ends in its head")
    size, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError(f"record at {at}: its length is damaged")
    body = file.read(size + struct.calcsize(CHECK))
    if len(body) < size + struct.calcsize(CHECK) or masked(body[:size]) != struct.unpack(CHECK, body[size:])[0]:
        raise ValueError(f"record at {at}: its payload is damaged")
    return body[:size]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(
    documents: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = None,
    id_bytes: int = 4,
    files: int | None = None,
) -> None:
    """Encode every text and write it to ``folder``, in ascending order of ``doc_id``.

    Null and empty texts become ``end_id`` alone. Null keys come first; rows with equal keys
    are ordered by text, and repeated rows are all written. Other columns are not written.
    ``files`` is the number of ranges (default: one for ``FILE_RECORDS`` rows, at least the session's
    shuffle partitions); ranges without rows leave no file. ``id_bytes`` is 2 where no id is over 65,535.
    """
    spark = documents.sparkSession
    if files is None:
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // FILE_RECORDS))
    code = {2: "H", 4: "I"}[id_bytes]
    end = b"" if end_id is None else end_id.to_bytes(id_bytes, "little")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = library_words(tokenizer, code)
        data = entries = None
        at = records = tokens = waiting = 0
        framed, places = [], array("Q")
        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if data is None:
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
                    data = system.open_output_stream(f"{name}.rec")
                    entries = system.open_output_stream(f"{name}.idx")
                ids = words.text(text.as_py()) + end
                record = frame(struct.pack(KEY, id_bytes, key is not None, key or 0) + ids)
                framed.append(record)
                places.extend((at, len(ids) // id_bytes))
                at += len(record)
                waiting += len(record)
                records += 1
                tokens += len(ids) // id_bytes
                if waiting >= WRITE_BYTES:
                    data.write(b"".join(framed))
                    framed.clear()
                    waiting = 0
        if data is not None:
            data.write(b"".join(framed))
            data.close()
            if sys.byteorder == "big":
                places.byteswap()
            entries.write(places.tobytes())
            entries.close()
            row = [part, f"{name}.rec", f"{name}.idx", records, tokens]
            row[1:3] = [x.rsplit("/", 1)[1] for x in row[1:3]]
            fields = ["part", "data", "entries", "records", "tokens"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, _ARROW, strict=True)], fields
            )

    (
        documents.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(save, _FILES)
        .write.parquet(f"{folder}/files")
    )


_ARROW = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def read(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """The records of a folder: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids``
    (binary, little-endian unsigned 32-bit).

    Each file is read by one task. With a ``seed`` a task visits the records of its file in a
    random order, by the index. Damaged records raise an error.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = spark.read.parquet(f"{folder}/files")  # one row for each file
    count = max(1, table.count())
    placed = table.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{base}/{row['entries']}") as file:
                    index = np.frombuffer(file.read(), "<u8").reshape(-1, 2)
                starts = row["start"] + np.cumsum(index[:, 1].astype(np.int64))
                order = list(range(len(index)))
                if seed is not None:
                    random.Random(f"{seed} {row['part']}").shuffle(order)
                with system.open_input_file(f"{base}/{row['data']}") as file:
                    rows, size = [], 0
                    for n in order:
                        at, many = map(int, index[n])
                        payload = unframe(file, at)
                        width, known, key = struct.unpack_from(KEY, payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(KEY))
                        if len(ids) != many:
                            raise ValueError(f"record at {at}: the index has another length")
                        rows.append(
                            (key if known else None, int(starts[n]) - many, many, ids.astype("<u4").tobytes())
                        )
                        size += 4 * many
                        if size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return placed.repartition(count, "part").mapInArrow(load, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
