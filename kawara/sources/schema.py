"""The catalogue's tables: schemas, rules for their values, storage as batches, and changes that reach it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import PREFS, SOURCE_TYPES
from ..operators.changes import update, upsert
from ..operators.durable import durable
from .partitions import FILE, Partitioned, bins, tier

SCHEMAS = {
    "sources": "id long, name string, url string, rss_url string, source_type string, pref string, city string, enabled boolean, last_crawled_at timestamp, created_at timestamp",
    "articles": "id long, source_id long, article_url string, title string, content string, thumbnail_url string, published_at timestamp, raw_html string, parsed boolean, created_at timestamp",
    "stores": "id long, name string, name_normalized string, addr string, addr_normalized string, pref string, city string, tel string, tel_normalized string, genre string, open_date date, listed_date date, thumbnail_url string, duplicate_flag boolean, duplicate_of_id long, created_at timestamp, updated_at timestamp, nearest_station string",
    "store_articles": "store_id long, article_id long",
    "crawls": "source_id long, crawled_at timestamp",
    "article_keys": "article_url string",
    "tops": "name string, top long",
}

#: Columns that must have a value, and those that must have one of a few.
REQUIRED = {
    "sources": ["id", "name", "url", "source_type", "enabled", "created_at"],
    "articles": ["id", "source_id", "article_url", "title", "published_at", "parsed", "created_at"],
    "stores": ["id", "name", "name_normalized", "pref", "city", "listed_date", "duplicate_flag"],
    "store_articles": ["store_id", "article_id"],
}
#: What goes with a row that is deleted: rows of these tables that name it. And columns that then name nobody.
CASCADES = {"sources": [("articles", "source_id"), ("crawls", "source_id")], "articles": [("store_articles", "article_id")], "stores": [("store_articles", "store_id")]}
SET_NULL = {"stores": [("stores", "duplicate_of_id")]}
#: Partitions by hash of the older keys; those of a batch that hasn't been compacted stand together, in this one.
BUCKETS, TOGETHER = 64, -1
#: Tables whose ids are given here, each with its part of the table of largest ids.
TOPPED = ("articles", "stores")
DOMAINS = {"sources": {"source_type": SOURCE_TYPES}, "stores": {"pref": PREFS}}


def violations(df: DataFrame, table: str) -> Column:
    """What is wrong with a row, as an array of column names in the table's order; columns that ``df`` lacks aren't judged."""
    bad = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED.get(table, []) if c in df.columns]
    bad += [F.when(~F.col(c).isin(values), F.lit(c)) for c, values in DOMAINS.get(table, {}).items() if c in df.columns]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the table takes, and the others with their ``violations``."""
    judged = df.withColumn("violations", violations(df, table))
    return judged.where("size(violations) = 0").drop("violations"), judged.where("size(violations) > 0")


def bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("long")


@dataclass(frozen=True)
class Tables:
    """Tables in a folder that all executors share, each a Parquet dataset with a partition for every batch.

    A batch replaces its own partition, so one that is run again leaves what it would have left; it reads only the
    batches before it. Changes (``delete``, ``update``, ``truncate``, ``purge``) find the batches that hold rows they
    hit by a semi join and write those again, and no others. Beside the tables stand the articles' keys (their URLs),
    older ones in partitions by hash, so a poll reads those of its items' hashes alone, and the largest ids given, so
    that none is given twice.
    """

    spark: SparkSession
    folder: str

    @cached_property
    def at(self) -> dict[str, Partitioned]:
        by = {"article_keys": ("batch", "bucket"), "tops": ("batch", "part")}
        return {t: Partitioned(self.spark, f"{self.folder}/{t}", schema, by.get(t, ("batch",))) for t, schema in SCHEMAS.items()}

    def create(self) -> Tables:
        for table in SCHEMAS:
            if table not in ("article_keys", "tops"):
                self.append(table, self.spark.createDataFrame([], SCHEMAS[table]), -1)
        return self

    def append(self, table: str, df: DataFrame, batch: int) -> None:
        """``df`` as the rows of ``batch``."""
        self.at[table].put_batch(df, batch)
        rows = self.at[table].read().where(F.col("batch") == batch)
        if table in TOPPED:
            self.at["tops"].put_batch(rows.agg(F.lit(table).alias("name"), F.max("id").alias("top")), batch, part=TOPPED.index(table))
        if table == "articles":
            self.at["article_keys"].put_batch(rows.select("article_url"), batch, bucket=TOGETHER)

    def append_batches(self, table: str, df: DataFrame) -> None:
        """``df`` with a column batch, as the rows of those batches."""
        df = durable(df)
        self.at[table].put(df)
        if table in TOPPED:
            self.at["tops"].put(df.groupBy("batch").agg(F.max("id").alias("top")).select("batch", F.lit(TOPPED.index(table)).alias("part"), F.lit(table).alias("name"), "top"))
        if table == "articles":
            self.at["article_keys"].put(df.select("batch", F.lit(TOGETHER).alias("bucket"), "article_url"))

    def read(self, table: str, before: int | None = None) -> DataFrame:
        df = self.at[table].read()
        return (df if before is None else df.where(F.col("batch") < before)).drop(*self.at[table].by)

    def top(self, table: str, before: int | None = None) -> int:
        """The largest id that the table's batches, or those ``before`` one, have given; 0 if none."""
        tops = self.at["tops"].read().where(F.col("name") == table)
        return (tops if before is None else tops.where(F.col("batch") < before)).agg(F.max("top")).first()[0] or 0

    def known(self, urls: DataFrame, before: int | None = None) -> DataFrame:
        """Keys (article_url) among which any of ``urls`` (one column) stands if it is an article's: those of the newest
        batches, and of older ones the partitions of the hashes that ``urls`` has."""
        (url,) = urls.columns
        used = sorted(r[0] for r in urls.select(bucket(F.col(url)).alias("b")).distinct().collect())  # at most BUCKETS
        keys = self.at["article_keys"].read().where(F.col("bucket").isin(TOGETHER, *used))
        return (keys if before is None else keys.where(F.col("batch") < before)).select("article_url")

    def sources(self, before: int | None = None) -> DataFrame:
        """The sources with the time of their last crawl."""
        last = self.read("crawls", before).groupBy(F.col("source_id").alias("id")).agg(F.max("crawled_at").alias("crawled_at"))
        joined = self.read("sources", before).join(last, "id", "left")
        return joined.withColumn("last_crawled_at", F.coalesce("crawled_at", "last_crawled_at")).drop("crawled_at")

    def seed(self, rows: DataFrame) -> None:
        """Sources (url and any other columns) merged into the table by their url; what ``rows`` doesn't supply stays."""
        defaults = {"enabled": F.lit(True), "created_at": F.current_timestamp()}
        self.append("sources", durable(upsert(self.read("sources"), rows, ["url"], defaults=defaults)), -1)

    # ---- changes

    def _change(self, table: str, hits: DataFrame, key: str, new) -> None:
        """The batches that hold rows named by ``hits`` (durable, a row a key) are written again as ``new`` makes them."""
        at = self.at[table]
        at.finish()
        rows = at.read()
        batches = sorted(r.batch for r in rows.join(hits.select(key), key, "left_semi").select("batch").distinct().collect())  # a row a batch
        if batches:
            at.replace(new(rows.where(F.col("batch").isin(batches))), batches)

    def delete(self, table: str, ids: DataFrame, key: str = "id") -> None:
        """Rows whose ``key`` is in ``ids`` go, with the rows of other tables that belong to them; a duplicate_of_id that
        names one becomes null. Deleted articles are known no more. Repeated ids and ids of nobody are harmless."""
        hits = durable(ids.select(key).where(F.col(key).isNotNull()).distinct())
        if key == "id":
            for child, column in SET_NULL.get(table, []):
                named = self.read(child).join(hits.select(F.col("id").alias(column)), column, "left_semi").join(hits, "id", "left_anti")
                self.update(child, named.select("id", F.lit(None).cast("long").alias(column)))
        if table in CASCADES:
            gone = hits if key == "id" else durable(self.read(table).join(hits, key, "left_semi").select("id"))
            for child, column in CASCADES[table]:
                self.delete(child, gone.select(F.col("id").alias(column)), column)
            if table == "articles":
                urls = durable(self.read(table).join(gone, "id", "left_semi").select("article_url").distinct())
                self._change("article_keys", urls, "article_url", lambda rows: rows.join(urls, "article_url", "left_anti"))
        self._change(table, hits, key, lambda rows: rows.join(hits, key, "left_anti"))

    def update(self, table: str, changes: DataFrame, key: str = "id", stamp: tuple[str, Column] | None = None) -> None:
        """Columns of ``changes`` on the rows that it names by ``key``, which must be distinct there; ``stamp`` as in
        ``changes.update``."""
        changes = durable(changes.where(F.col(key).isNotNull()))
        self._change(table, changes, key, lambda rows: update(rows, changes, key, stamp))

    def truncate(self, *tables: str) -> None:
        """No rows in ``tables``; articles that are gone are known no more, ids that were given aren't given again."""
        for table in [*tables, *(["article_keys"] if "articles" in tables else [])]:
            at = self.at[table]
            at.finish()
            at.replace(at.read().where("false"), sorted(at.sizes()))

    def purge(self, as_of: Column, years: int = 2) -> None:
        """Stores listed, and articles published, more than ``years`` before ``as_of`` go, as ``delete`` takes them."""
        oldest = as_of - F.expr(f"INTERVAL '{years}' YEAR")
        self.delete("stores", self.read("stores").where(F.col("listed_date") < oldest).select("id"))
        self.delete("articles", self.read("articles").where(F.col("published_at") < oldest).select("id"))

    def compact(self, before: int, *, least: int = 16, target: int | None = None) -> None:
        """Batches among those ``before`` one become fewer, under the number of their newest.

        All that are small beside each other become one, however large they are (``tier``); with ``target`` small ones
        become batches of at most so many bytes (``bins``), which later changes write again more cheaply. A batch's
        rows are dealt to several tasks and files of about FILE bytes.

        Only batches that no run will write again may be named: in a poll, those before its own. Of crawls and given
        ids the largest of each name is kept; keys go to the partitions of their hashes.
        """
        for table, at in self.at.items():
            at.finish()
            sizes = {b: n for b, n in at.sizes().items() if 0 <= b < before}
            found = tier(sizes, least) if target is None else bins(sizes, target, least)
            if not found:
                continue
            moved = self.spark.createDataFrame([(b, x[-1]) for x in found for b in x], "batch long, into long")
            rows = at.read().where(F.col("batch").isin([b for x in found for b in x]))
            rows = rows.join(F.broadcast(moved), "batch").withColumn("batch", F.col("into")).drop("into")
            if table == "crawls":
                rows = rows.groupBy("batch", "source_id").agg(F.max("crawled_at").alias("crawled_at"))
            if table == "tops":
                rows = rows.groupBy("batch", "part", "name").agg(F.max("top").alias("top"))
            if table == "article_keys":
                rows = rows.distinct().withColumn("bucket", bucket(F.col("article_url")))
            files = max(-(-sum(sizes[b] for b in x) // FILE) for x in found)
            rows = rows.repartition(*at.by, F.pmod(F.xxhash64(*rows.columns), F.lit(files)))
            at.replace(rows, sorted(b for x in found for b in x))
