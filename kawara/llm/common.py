"""Helpers shared by the operators: durable cuts of the lineage, blocks of rows, free column names, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema as to_arrow

from kawara.operators.components import components
from kawara.operators.durable import durable, shared_folder

__all__ = ["batches_of", "blocks", "box", "boxed", "components", "durable", "fields", "free", "give_back", "pack_ints", "pack_longs", "partitions", "settled", "shared_folder", "to_arrow", "trimmed", "unboxed", "unpack_ints", "unpack_longs", "utf8", "words"]


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def fields(df: DataFrame, drop: tuple[str, ...] = ()) -> list[T.StructField]:
    """The fields of ``df`` but for ``drop``, all nullable."""
    return [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in drop]


def white_to_space(col):
    return F.translate(col, "\t\n\x0b\x0c\r", "     ")


def words(col):
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(white_to_space(F.coalesce(col, F.lit(""))), " ", -1), "")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches; when it ends, what the worker no longer needs goes back to the system: a
    worker stays for the stages that follow, and with it the memory that the allocators hold for its next task."""

    def kept(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc nothing needs doing
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs in the block hands rows to Python in batches of about ``size`` bytes (and one row at least), which the
    executor and its worker both hold, instead of 10,000 rows or 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of a partition as tables of about ``block_bytes`` of text, each with a number that no other has.

    The cuts follow from the rows alone, not from how they arrive in batches.
    """
    number, held, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        start = 0
        ends = size + np.cumsum(lengths, dtype=np.int64)
        while start < len(lengths):
            cut = int(np.searchsorted(ends, block_bytes)) + 1  # rows up to the one that fills the block
            if cut > len(lengths):
                break
            held.append(batch.slice(start, cut - start))
            yield number, pa.Table.from_batches(held)
            number, held, start = number + 1, [], cut
            ends = ends - ends[cut - 1]
            ends[:cut] = -1
        if start < len(lengths):
            held.append(batch.slice(start))
            size = int(ends[-1])
        else:
            size = 0
    if held:
        yield number, pa.Table.from_batches(held)


def box(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table, max_chunksize=1 << 20)
    return sink.getvalue().to_pybytes()


def unboxed(rows: pa.Scalar | bytes) -> pa.Table:
    with pa.ipc.open_stream(rows.as_buffer() if isinstance(rows, pa.Scalar) else rows) as stream:
        return stream.read_all()


def boxed(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """``docs`` in blocks of about ``block_bytes`` of text, written: (block long, size long, rows binary) a block.

    ``rows`` is the block's table, to be read by ``unboxed``. The numbers of blocks follow partitions and arrival, so
    the result is written at once: a task that runs again never deals rows into other blocks than its readers know.
    """

    def run(batches):
        for number, table in blocks(batches, text, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pc.sum(pc.binary_length(table[text])).as_py() or 0]), pa.array([box(table)], pa.binary())], ["block", "size", "rows"])

    return durable(docs.mapInArrow(trimmed(run), "block long, size long, rows binary"))


#: Steps that give a partition's rows in the same order whenever it is made again.
_STEADY = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "MapInArrow", "MapInPandas", "Generate", "SubqueryAlias", "LocalLimit"}


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` as they are where they are read from files and only narrowed, else a written copy: after a shuffle a task
    that runs again may meet its rows in another order, and would number its blocks otherwise than others have read."""
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in _STEADY:
            return durable(docs)
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return docs


def partitions(df: DataFrame, size: int, each: int) -> int:
    """How many partitions take ``size`` bytes, about ``each`` in one; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned integers under 2**32 as four planes of bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack_longs(a: np.ndarray) -> bytes:
    """Unsigned integers as eight planes of bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_longs(b: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
