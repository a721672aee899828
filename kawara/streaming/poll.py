"""Incremental ingestion: feeds that land in a folder, taken in once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.durable import scratch
from ..plans import served
from ..plans.ingest import ingest, skip_known
from ..plans.maintain import find_sources
from ..sources.schema import Tables

FEEDS = "source_id long, xml string, fetched_at timestamp"


def poll(spark: SparkSession, feeds_folder: str, pages: DataFrame, tables: Tables, checkpoint: str, keyword: str = "", compact_from: int = 16, view: bool = False) -> StreamingQuery:
    """Start a query that ingests all feeds (Parquet files of FEEDS) that have landed since it last ran, and then ends.

    Every batch appends a partition to each table and reads only the batches before it, so one that is run again after
    a failure replaces what it had left. Articles are known by their URL, so feeds that repeat them add nothing. A
    batch numbers its rows after all earlier ones; run one query at a time for a set of tables. Before it begins, small
    batches before it, once they are ``compact_from``, are made one (``Tables.compact``), so that neither files nor partitions grow with the number of
    polls. With ``keyword`` only sources whose name or address holds it take part, with ``view`` the stored view
    (``plans.served``, rebuilt once before) is kept up to date.
    """
    feeds = spark.readStream.schema(FEEDS).parquet(feeds_folder)

    def take(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            take_in(batch, number)

    def take_in(batch: DataFrame, number: int) -> None:
        tables.compact(number, least=compact_from)
        tops = tables.top("articles", number), tables.top("stores", number)
        out = ingest(batch, pages, find_sources(tables.sources(number), keyword), lambda links: tables.known(links, number), tables.read("stores", number), F.current_timestamp(), tops)
        for name, rows in (("articles", out.articles), ("stores", out.stores), ("store_articles", out.links), ("crawls", out.crawls)):
            tables.append(name, rows, number)
        if view:
            served.merge_batch(tables, number)

    return feeds.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_once(stream: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """``stream`` without the rows whose key another one had up to ``within`` before: its state holds keys so long, and no
    longer, whatever the stream's length. Rows that come later than that after the newest are dropped."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, key: str, order: str, folder: str, checkpoint: str, *, first_batch: int = 0, at: str = "", within: str = "") -> StreamingQuery:
    """Start a query that appends to ``folder`` the rows of ``stream`` whose key it doesn't hold, of equal keys the first by ``order``.

    ``first_batch`` is above every batch that other runs have left, so a query with a new checkpoint goes on after
    them. Batches are partitions, as in Tables. Rows without a key are left out. With ``at`` (a column of time) and
    ``within`` repeats that come so soon go before a batch is compared with what is held (``recent_once``).
    """
    spark, schema = stream.sparkSession, stream.schema
    if within:
        stream = recent_once(stream, key, at, within)
    held = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")

    def take(batch: DataFrame, number: int) -> None:
        number += first_batch
        known = spark.read.option("basePath", folder).schema(held).parquet(folder).where(F.col("batch") < number)
        fresh = skip_known(batch.where(F.col(key).isNotNull()), key, known, key)
        rest = [c for c in batch.columns if c != key]
        one = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(key, "row.*").select(*batch.columns)
        one.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
