"""Audits and repairs of the catalogue, each one pass or one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..functions.text import any_of, extract_genre
from ..operators.changes import delete_stores, update
from ..sources.schema import Tables


def any_part(text: Column, parts: list[str]) -> Column:
    """Whether the text holds one of the parts, in either case."""
    return any_of(F.lower(text), [p.lower() for p in parts])


def audit(stores: DataFrame, parts: list[str] = words.SUSPICIOUS) -> DataFrame:
    """One row: n stores, those with an address, a station and a phone, the rounded percentages, and suspicious names. No stores: 0 percent."""
    have = {"addr": "addr", "station": "nearest_station", "tel": "tel"}
    counts = stores.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{k}") for k, c in have.items()], F.count_if(any_part(F.col("name"), parts)).alias("n_suspicious"))
    share = lambda k: F.coalesce(F.floor(F.try_divide(F.col(f"n_{k}") * 100, F.col("n")) + 0.5), F.lit(0)).cast("long")
    return counts.select("*", *[share(k).alias(f"{k}_percent") for k in have])


def count_by(stores: DataFrame, column: str = "pref") -> DataFrame:
    return stores.groupBy(column).agg(F.count("*").alias("n"))


def suspicious(stores: DataFrame, parts: list[str] = words.SUSPICIOUS, limit: int | None = None) -> DataFrame:
    """Stores whose names hold one of the parts; with ``limit`` the first by id, for a report."""
    out = stores.where(any_part(F.col("name"), parts))
    return out if limit is None else out.orderBy("id").limit(limit)


def clean_up(stores: DataFrame, links: DataFrame, parts: list[str] = words.NOISE) -> tuple[DataFrame, DataFrame]:
    """Stores and links without the stores whose names hold one of the parts; the articles stay known."""
    return delete_stores(stores, links, suspicious(stores, parts).select("id"))


def reclassified(stores: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, genre) of stores whose genre, by the article of theirs with the least id, is known and another."""
    one = links.groupBy(F.col("store_id").alias("id")).agg(F.min("article_id").alias("article_id"))
    read = one.join(articles.select(F.col("id").alias("article_id"), "title", "content"), "article_id")
    # exploded, so that the filter on it doesn't move below the join, where it would be worked out for every article
    read = read.select("id", F.explode(F.array(extract_genre(F.coalesce("content", F.lit("")), F.col("title")))).alias("found"))
    both = stores.select("id", "genre").join(read, "id")
    return both.where("found IS NOT NULL AND NOT found <=> genre").select("id", F.col("found").alias("genre"))


def reclassify(stores: DataFrame, links: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """Stores with their genres as reclassified; updated_at is ``now`` where they changed."""
    return update(stores, reclassified(stores, links, articles), stamp=("updated_at", now))


def clean_up_in(tables: Tables, parts: list[str] = words.NOISE) -> None:
    """``clean_up`` of the tables themselves."""
    tables.delete("stores", suspicious(tables.read("stores"), parts).select("id"))


def reclassify_in(tables: Tables, now: Column) -> None:
    """``reclassify`` of the tables themselves."""
    tables.update("stores", reclassified(tables.read("stores"), tables.read("store_articles"), tables.read("articles")), stamp=("updated_at", now))


def reset_in(tables: Tables) -> None:
    """No articles, stores and links, so that the next poll takes in everything again; sources and their crawls stay."""
    tables.truncate("store_articles", "stores", "articles")


def probe_split(candidates: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
    """``candidates`` (url) with items and status: 'known', else 'fresh' with items in its feed, else 'dead'. Without a count, -1."""
    have = known.select("url", F.lit(True).alias("have")).distinct()
    rows = candidates.join(counts.select("url", "items"), "url", "left").join(have, "url", "left").withColumn("items", F.coalesce("items", F.lit(-1)).cast("long"))
    status = F.when(F.col("have"), "known").when(F.col("items") > 0, "fresh").otherwise("dead")
    return rows.withColumn("status", status).drop("have")


def probe_counts(split: DataFrame) -> DataFrame:
    """(status, n): how many candidates are fresh, dead and known; none is 0."""
    return split.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "dead", "known")]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in ("fresh", "dead", "known")])).alias("c")).select("c.*")


def fresh_order() -> list[Column]:
    """The order in which fresh candidates are listed: by prefecture, then address."""
    return [F.collate("pref", "ja").asc(), F.col("pref").asc(), F.col("url").asc()]


def latest(rows: DataFrame, at: str, n: int, key: str = "id") -> DataFrame:
    """The ``n`` latest rows for a report, of equals those with the larger key."""
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def inspect_articles(articles: DataFrame, n: int = 3, shown: int = 400) -> DataFrame:
    """The latest articles with the length of their content and its first characters."""
    content = F.coalesce("content", F.lit(""))
    return latest(articles, "published_at", n).select("id", "title", "article_url", F.length(content).alias("content_length"), F.substring(content, 1, shown).alias("content"))


def inspect_city(stores: DataFrame, city: str = "越谷市", n: int = 50) -> DataFrame:
    """The newest stores of a city."""
    return latest(stores.where(F.col("city") == city), "created_at", n).select("id", "name", "genre", "created_at")


def find_sources(sources: DataFrame, part: str = "") -> DataFrame:
    """Enabled sources; with ``part`` those whose name or address holds it, in either case."""
    on = sources.where("enabled")
    held = lambda c: F.contains(F.lower(c), F.lit(part.lower()))
    return on.where(held("name") | held("url")) if part else on
