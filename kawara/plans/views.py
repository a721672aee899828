"""The catalogue as it is served: stores with the articles and sources that told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import OTHER_GENRE
from ..operators.durable import numbered
from ..operators.serving import Filters, apply_filters, apply_order, predicate

SERVED = ["id", "name", "addr", "pref", "city", "tel", "genre", "nearest_station", "open_date", "listed_date", "thumbnail_url", "duplicate_flag", "duplicate_of_id"]


def latest_titles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(store_id, article_title): the title of each store's latest article, of equals the one with the larger id."""
    read = links.join(articles.select(F.col("id").alias("article_id"), "title", "published_at"), "article_id")
    return read.groupBy("store_id").agg(F.max_by("title", F.struct("published_at", "article_id")).alias("article_title"))


def stores_with_sources(stores: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Stores with article_title and sources, array<struct<name, url, title, type>>, latest article first.

    The bridge side is joined and gathered by store before the stores come in, so a store's columns never travel with
    its articles. Stores without articles have no title and an empty array. A store's sources are one value, as large
    as its articles are many.
    """
    read = links.join(articles.select(F.col("id").alias("article_id"), "source_id", F.col("article_url").alias("url"), "title", "published_at"), "article_id")
    read = read.join(sources.select(F.col("id").alias("source_id"), "name", F.col("source_type").alias("type")), "source_id", "left")
    told = read.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("published_at", "article_id", "name", "url", "title", "type")), asc=False).alias("told"))
    return with_told(stores.select(*SERVED).join(told.withColumnRenamed("store_id", "id"), "id", "left"))


def with_told(rows: DataFrame) -> DataFrame:
    """``rows`` with article_title and sources in place of told, what articles tell of a store, the latest first."""
    sources = F.transform("told", lambda t: F.struct(t["name"].alias("name"), t["url"].alias("url"), t["title"].alias("title"), t["type"].alias("type")))
    empty = F.array().cast("array<struct<name:string,url:string,title:string,type:string>>")
    return rows.withColumn("article_title", F.get("told", F.lit(0))["title"]).withColumn("sources", F.coalesce(sources, empty)).drop("told")


def with_originals(stores: DataFrame) -> DataFrame:
    """``stores`` with original_name, the name of the store that each is a possible duplicate of; null without one."""
    originals = stores.select(F.col("id").alias("duplicate_of_id"), F.col("name").alias("original_name"))
    return stores.join(originals, "duplicate_of_id", "left").select(*stores.columns, "original_name")


def serving_rows(view: DataFrame) -> DataFrame:
    """The view's rows as they are served: ids as text, empty strings for what is missing, sources without titles."""
    blank: Column = F.lit("")
    return view.select(
        F.col("id").cast("string").alias("id"),
        "name",
        "article_title",
        F.coalesce("addr", blank).alias("addr"),
        "pref",
        "city",
        F.col("listed_date").alias("date"),
        F.coalesce(F.col("open_date").cast("string"), blank).alias("open_date"),
        F.coalesce("genre", F.lit(OTHER_GENRE)).alias("genre"),
        F.coalesce("tel", blank).alias("tel"),
        "nearest_station",
        F.coalesce("thumbnail_url", blank).alias("thumb"),
        F.transform("sources", lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url"), s["type"].alias("type"))).alias("sources"),
        "duplicate_flag",
        F.when(F.col("duplicate_of_id") != 0, F.col("duplicate_of_id").cast("string")).alias("duplicate_of_id"),
    )


def matching(stores: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, filters: Filters, today: Column, hidden: DataFrame | None = None) -> DataFrame:
    """Serving rows that ``filters`` let pass, in no order.

    What a store's own columns decide filters the scan of stores; where that is asked for, links of other stores go
    before their articles are joined and gathered.
    """
    genre = filters.genre if filters.genre != OTHER_GENRE else ""  # that one stands for none, too
    narrow = Filters(pref=filters.effective_pref, city=filters.city, within_days=filters.within_days, genre=genre, require_tel=filters.require_tel, require_addr=filters.require_addr)
    if narrow != Filters():
        stores = stores.where(predicate(narrow, today, date="listed_date"))
        links = links.join(stores.select(F.col("id").alias("store_id")), "store_id", "left_semi")
    return apply_filters(serving_rows(stores_with_sources(stores, links, articles, sources)), filters, today, hidden)


def serve(stores: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, filters: Filters, today: Column, hidden: DataFrame | None = None) -> DataFrame:
    """One lazy plan from the tables to the ordered rows of a page."""
    return apply_order(matching(stores, links, articles, sources, filters, today, hidden), filters.order)


def facets(stores: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, pref: str = "") -> DataFrame:
    """The choices that a reader has, sorted: (facet, value, position) of cities in the prefecture, genres and names of sources.

    Cities and genres come from stores alone, names from the sources of articles that a store has; each side is made
    distinct before it is joined on. A source without a name comes last, as null.
    """
    kept = stores.where(F.col("pref") == pref) if pref else stores
    cities = kept.select(F.lit("city").alias("facet"), F.col("city").alias("value"))
    genres = stores.select(F.lit("genre"), F.coalesce("genre", F.lit(OTHER_GENRE)))
    told = links.join(stores.select(F.col("id").alias("store_id")), "store_id", "left_semi").select(F.col("article_id").alias("id"))
    told = articles.select("id", "source_id").join(told, "id", "left_semi").select("source_id").distinct()
    names = told.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left").select(F.lit("source"), "name")
    values = cities.distinct().unionByName(genres.toDF("facet", "value").distinct()).unionByName(names.toDF("facet", "value").distinct())
    placed = numbered(values, [F.col("facet").asc(), F.col("value").asc_nulls_last()], "position")
    first = placed.groupBy("facet").agg(F.min("position").alias("first"))  # a row a facet
    return placed.join(F.broadcast(first), "facet").select("facet", "value", (F.col("position") - F.col("first") + 1).alias("position"))
