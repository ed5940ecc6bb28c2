"""Documents in blocks of bounded size, for operators that come back to the texts.

A block is a row: some documents as one compressed Arrow table. ``stored`` writes the blocks to the shared
folder with their numbers, so that what later stages find for a block (fingerprints, counts, candidates) meets
the same documents again, also after an executor was lost, and texts move as compressed blocks.
``numbered`` stores nothing: blocks are cut anew wherever they are used, and are the same each time if
``docs`` is a stored table, whose splits do not change. They carry a digest, so that a user can tell.

A block ends at ``BYTES`` bytes of text or at the end of an input split; a longer text is a block of
its own. Nulls stay nulls; an empty table gives no block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import prepare

BYTES = 8 * 1024 * 1024
SCHEMA = "rows long, bytes long, data binary"


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def block(parts: list[pa.RecordBatch], held: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        arrays = [pa.array([rows.num_rows], pa.int64()), pa.array([held], pa.int64()), pa.array([packed(rows)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["rows", "bytes", "data"])

    parts, held = [], 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        start = 0
        while start < batch.num_rows:
            ends = held + np.cumsum(sizes[start:])
            stop = start + min(int(np.searchsorted(ends, size)) + 1, batch.num_rows - start)
            parts.append(batch.slice(start, stop - start))
            held, start = int(ends[stop - start - 1]), stop
            if held >= size:
                yield block(parts, held)
                parts, held = [], 0
    if parts:
        yield block(parts, held)


def _number(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    for n, batch in enumerate(_cut(batches, size)):
        digest = xxhash.xxh64_intdigest(batch.column("data")[0].as_buffer()) >> 1
        columns = [pa.array([first + n], pa.int64()), *batch.columns, pa.array([digest], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "rows", "bytes", "data", "digest"])


def numbered(docs: DataFrame, text: Column, size: int = BYTES, **columns: Column) -> DataFrame:
    """``block, rows, bytes, data, digest`` as ``stored`` gives, cut anew at each use."""
    prepare(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], text.cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _number(batches, size), f"block long, {SCHEMA}, digest long")


def stored(docs: DataFrame, text: Column, size: int = BYTES, **columns: Column) -> DataFrame:
    """``block, rows, bytes, data`` of the documents, their text in bytes as ``text``, next to ``columns``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], text.cast("binary").alias("text"))
    made = rows.mapInArrow(lambda batches: _cut(batches, size), SCHEMA)
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4()}"
    made.select(F.monotonically_increasing_id().alias("block"), "*").write.parquet(path)
    return spark.read.parquet(path)


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
