"""Cuts of the lineage that survive lost executors, and running numbers made without one task for all rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small row groups, whose size is looked at every ten rows: a task that writes wide rows holds few of them.
SMALL = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 10}

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths written inside each open ``scratch``.
_scratches: list[list[str]] = []


def durable(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet to a new path in the shared folder and read from there.

    ``replaces``, an earlier result of this function that nothing reads any more once ``df`` is written, is deleted
    then, so a loop keeps the files of one round.
    """
    path = shared_folder(df.sparkSession)
    for paths in _scratches[-1:]:
        paths.append(path)
    df.write.options(**SMALL).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    if replaces is not None:
        forget(replaces)
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``df``; other DataFrames have nothing to delete."""
    if path := _written.pop(df, None):
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever ``durable`` writes in the block is deleted at its end: for blocks that write or collect their results
    themselves. An inner block deletes its own alone."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, the context's own, or else one in
    the warehouse, which on a cluster must not be a folder of the driver's machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/kawara_shared"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {base} is the driver's own")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1, *, written: bool = False) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in ``order``, which must be total for numbers that don't change.

    Rows are written first, unless they are read from what is ``written`` already, as ranges are found by a sample of
    them; then they are dealt by ranges of the order and numbered in their own partition, and only the partitions'
    counts are added up. No rows, no numbers.
    """
    at, part = f"{name}__at", f"{name}__part"
    given = df if written else durable(df)
    rows = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = durable(rows.withColumn(part, F.shiftright(at, 33)), replaces=given)
    counts = sorted(tuple(r) for r in rows.groupBy(part).count().collect())  # a row a partition
    before, offsets = start, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    shifts = df.sparkSession.createDataFrame(offsets, f"{part} long, {name} long")
    place = F.col(name) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(shifts), part).withColumn(name, place).drop(part, at)
