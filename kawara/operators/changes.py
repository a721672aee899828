"""Changes of tables as new snapshots: insert, upsert, update, delete, truncate, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import numbered


def insert(table: DataFrame, rows: DataFrame, order: list[Column], defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``table`` with ``rows`` under new ids after the largest, in ``order``; and the rows with their ids.

    Columns that ``rows`` lacks take their default, or null.
    """
    first = (table.agg(F.max("id")).first()[0] or 0) + 1
    added = numbered(rows.drop("id"), order, "id", first)
    added = added.select(*[F.col(f.name).cast(f.dataType) if f.name in added.columns else (defaults or {}).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    return table.unionByName(added), added


def upsert(table: DataFrame, rows: DataFrame, key: list[str], *, order: Column | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``table`` with ``rows`` merged on ``key``: known keys take the supplied columns, others are inserted.

    Columns that ``rows`` doesn't supply keep their value, so they are unchanged by a second run. Of rows with one key
    the last by ``order`` counts; of equals, or without an order, the one with the largest columns. A null key equals no key and is inserted. Where the table has
    an id, new rows are numbered after the largest by their key.
    """
    supplied = [c for c in rows.columns if c not in key]
    ranks = F.struct(*([order.alias("order")] if order is not None else []), *supplied)
    latest = F.max_by(F.struct(*supplied, F.lit(True).alias("found")), ranks) if supplied else F.first(F.struct(F.lit(True).alias("found")))
    keyed = " AND ".join(f"{k} IS NOT NULL" for k in key)
    last = rows.where(keyed).groupBy(*key).agg(latest.alias("given"))
    known = table.join(last, key, "left")
    given = lambda c, t: F.when(F.col("given.found"), F.col(f"given.{c}")).otherwise(F.col(c)).cast(t).alias(c)
    updated = known.select(*[given(f.name, f.dataType) if f.name in supplied else F.col(f.name) for f in table.schema.fields])
    fresh = last.join(table.select(*key), key, "left_anti").select(*key, "given.*").drop("found").unionByName(rows.where(f"NOT ({keyed})"))
    if "id" in table.columns and "id" not in rows.columns:
        return updated.unionByName(insert(table, fresh, [F.col(k) for k in key], defaults)[1])
    return updated.unionByName(fresh.select(*[F.col(f.name).cast(f.dataType) if f.name in fresh.columns else (defaults or {}).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]))


def update(table: DataFrame, changes: DataFrame, key: str = "id", stamp: tuple[str, Column] | None = None) -> DataFrame:
    """``table`` with the columns of ``changes`` where their row is named there; ``stamp`` (column, value) is set on those rows."""
    changed = [c for c in changes.columns if c != key]
    rows = table.join(changes.select(key, F.struct(*changed, F.lit(True).alias("found")).alias("given")), key, "left")
    hit = F.coalesce(F.col("given.found"), F.lit(False))

    def value(f) -> Column:
        if f.name in changed:
            return F.when(hit, F.col(f"given.{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        if stamp and f.name == stamp[0]:
            return F.when(hit, stamp[1]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        return F.col(f.name)

    return rows.select(*[value(f) for f in table.schema.fields])


def delete_stores(stores: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores and links without the stores of ``ids`` (id)."""
    ids = ids.select("id").distinct()
    return stores.join(ids, "id", "left_anti"), links.join(ids.select(F.col("id").alias("store_id")), "store_id", "left_anti").select(*links.columns)


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def purge(stores: DataFrame, articles: DataFrame, links: DataFrame, as_of: Column, years: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without stores listed, and articles published, more than ``years`` before ``as_of``, nor links to them.

    A duplicate_of_id that names a purged store becomes null.
    """
    oldest = as_of - F.expr(f"INTERVAL '{years}' YEAR")
    kept = stores.where(F.col("listed_date") >= oldest)
    read = articles.where(F.col("published_at") >= oldest)
    gone = stores.where(F.col("listed_date") < oldest).select(F.col("id").alias("duplicate_of_id"), F.lit(True).alias("gone"))
    kept = kept.join(gone, "duplicate_of_id", "left").withColumn("duplicate_of_id", F.when(F.col("gone").isNull(), F.col("duplicate_of_id"))).select(*stores.columns)
    joined = links.join(kept.select(F.col("id").alias("store_id")), "store_id", "left_semi").join(read.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return kept, read, joined.select(*links.columns)
