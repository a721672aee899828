"""The served view as a table that polls keep up to date: a batch's links say which stores' arrays grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..sources.partitions import Partitioned
from ..sources.schema import SCHEMAS, Tables
from .views import SERVED, with_told

#: Store ids in a partition of the view; a batch writes again those that its stores are in.
PER_PART = 1 << 17

_TYPES = dict(c.split(" ", 1) for c in SCHEMAS["stores"].split(", "))
_ONE = "struct<published_at: timestamp, article_id: bigint, name: string, url: string, title: string, type: string>"


def _at(tables: Tables) -> Partitioned:
    return Partitioned(tables.spark, f"{tables.folder}/served", ", ".join([*[f"{c} {_TYPES[c]}" for c in SERVED], f"told array<{_ONE}>"]))


def _part(of: Column) -> Column:
    return F.floor(of / PER_PART).cast("long")


def _told(links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, told): what the articles of ``links`` tell of each store, in no order."""
    read = links.join(articles.select(F.col("id").alias("article_id"), "source_id", F.col("article_url").alias("url"), "title", "published_at"), "article_id")
    read = read.join(sources.select(F.col("id").alias("source_id"), "name", F.col("source_type").alias("type")), "source_id", "left")
    return read.groupBy(F.col("store_id").alias("id")).agg(F.collect_list(F.struct("published_at", "article_id", "name", "url", "title", "type").cast(_ONE)).alias("told"))


def _sorted(told: Column) -> Column:
    return F.sort_array(F.array_distinct(F.coalesce(told, F.array().cast(f"array<{_ONE}>"))), asc=False)


def _put(at: Partitioned, rows: DataFrame, touched: DataFrame) -> None:
    """``rows`` in place of what the view says of the stores of ``touched`` (id); other stores of their partitions stay."""
    touched = durable(touched.distinct())
    parts = sorted(r[0] for r in touched.select(_part(F.col("id")).alias("p")).distinct().collect())  # a row a partition
    if parts:
        stay = at.read().where(F.col("batch").isin(parts)).join(touched, "id", "left_anti")
        at.replace(rows.withColumn("batch", _part(F.col("id"))).unionByName(stay.select(*rows.columns, "batch")), parts)


def rebuild(tables: Tables) -> None:
    """The view of all stores, from the tables."""
    at = _at(tables)
    at.put_batch(tables.spark.createDataFrame([], at.schema), -1)
    rows = durable(tables.read("stores").select(*SERVED).join(_told(tables.read("store_articles"), tables.read("articles"), tables.read("sources")), "id", "left").withColumn("told", _sorted(F.col("told"))))
    at.replace(rows.withColumn("batch", _part(F.col("id"))), sorted({*at.sizes()} | {r[0] for r in rows.select(_part(F.col("id")).alias("p")).distinct().collect()}))


def refresh(tables: Tables, ids: DataFrame) -> None:
    """The view of the stores of ``ids`` (id) alone, from the tables: after changes to them. Deleted ones go."""
    ids = durable(ids.select("id").distinct())
    of = ids.select(F.col("id").alias("store_id"))
    told = _told(tables.read("store_articles").join(of, "store_id", "left_semi"), tables.read("articles"), tables.read("sources"))
    rows = tables.read("stores").select(*SERVED).join(ids, "id", "left_semi").join(told, "id", "left").withColumn("told", _sorted(F.col("told")))
    _put(_at(tables), durable(rows), ids)


def merge_batch(tables: Tables, batch: int) -> None:
    """What one batch of a poll adds to the view: its new stores, and its links' articles in the arrays of theirs.

    Only the batch's own partitions of the tables and the view's partitions of the stores that it names are read; an
    array that has what is added already stays, so a batch may be merged again.
    """
    own = lambda t: tables.at[t].read().where(F.col("batch") == batch).drop("batch")
    told = durable(_told(own("store_articles"), own("articles"), tables.read("sources")))
    made = durable(own("stores").select(*SERVED).withColumn("told", F.array().cast(f"array<{_ONE}>")))
    touched = durable(told.select("id").union(made.select("id")).distinct())
    parts = sorted(r[0] for r in touched.select(_part(F.col("id")).alias("p")).distinct().collect())  # a row a partition
    known = _at(tables).read().where(F.col("batch").isin(parts)).drop("batch").join(made, "id", "left_anti")
    rows = made.unionByName(known.join(touched, "id", "left_semi").select(*made.columns)).join(told.withColumnRenamed("told", "more"), "id", "left")
    merged = rows.withColumn("told", _sorted(F.concat("told", F.coalesce("more", F.array().cast(f"array<{_ONE}>"))))).drop("more")
    _put(_at(tables), durable(merged), touched)


def view(tables: Tables) -> DataFrame:
    """The stored view, as ``views.stores_with_sources`` makes it from the tables."""
    return with_told(_at(tables).read().select(*SERVED, "told"))
