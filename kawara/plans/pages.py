"""Pages of an ordered list by the last row of the page before: a snapshot laid out by ranges of the order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A column of the order. Nulls come last."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.descending else F.col(self.column).asc_nulls_last()

    def backwards(self) -> Column:
        return F.col(self.column).asc_nulls_first() if self.descending else F.col(self.column).desc_nulls_first()

    def after(self, value: Column, column: str | None = None) -> Column:
        own = F.col(column or self.column)
        beyond = own < value if self.descending else own > value
        return F.when(value.isNull(), F.lit(False)).otherwise(own.isNull() | beyond)


def after(keys: list[Key], row: dict, prefix: str = "") -> Column:
    """Whether a row comes after ``row`` in the order of ``keys``; ``prefix`` stands before the columns' names."""
    out, equal = [], F.lit(True)
    for k in keys:
        value = F.lit(row[k.column])
        out.append(equal & k.after(value, prefix + k.column))
        equal = equal & F.col(prefix + k.column).eqNullSafe(value)
    return reduce(lambda a, b: a | b, out)


def lay_out(rows: DataFrame, keys: list[Key], folder: str, *, files: int) -> None:
    """Write ``rows`` to ``folder`` in about ``files`` parts, each a range of the order, and a list of their last rows.

    The order must be total (its last key distinct), so that a row has one place. An earlier snapshot is replaced.
    """
    dealt = rows.repartitionByRange(files, *[k.order() for k in keys]).withColumn("part", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    dealt.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")  # rows that aren't there have no files to tell it
    held = rows.sparkSession.read.schema(dealt.schema).parquet(f"{folder}/rows")
    own = Window.partitionBy("part")
    ends = held.select("part", *[k.column for k in keys]).withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy(*[k.backwards() for k in keys])))
    last = ends.where("place = 1").select("part", "n", *[F.col(k.column).alias(f"last_{k.column}") for k in keys])
    last.coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")


def page(spark: SparkSession, folder: str, keys: list[Key], size: int, last: dict | None = None) -> DataFrame:
    """The ``size`` rows after ``last`` (the keys' values of the row that ended the page before), in order; the first ones without it.

    Of the list of parts, a row each, those that end after ``last`` are asked for until they hold the page; only their
    files are read, so a late page costs what the first does.
    """
    parts = spark.read.parquet(f"{folder}/parts")
    if last is not None:
        parts = parts.where(after(keys, last, "last_"))
    wanted, held = [], 0
    for r in parts.select("part", "n").orderBy("part").limit(2 + size).collect():  # each part has a row or more
        wanted.append(r.part)
        held += r.n if len(wanted) > 1 or last is None else 0  # of the first, maybe one row is left
        if held >= size:
            break
    rows = spark.read.schema(spark.read.parquet(f"{folder}/shape").schema).parquet(f"{folder}/rows").where(F.col("part").isin(wanted)).drop("part")
    if last is not None:
        rows = rows.where(after(keys, last))
    return rows.orderBy(*[k.order() for k in keys]).limit(size)
