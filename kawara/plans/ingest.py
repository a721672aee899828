"""From feeds to articles, stores and links: one batch, as a plan over tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import html, text
from ..operators.durable import durable, numbered
from ..operators.resolve import resolve
from ..sources.feeds import feed_items, published_at

#: Characters of an article that are kept (fixed value).
CONTENT = 5000


@dataclass(frozen=True)
class Batch:
    """The rows that a batch adds, the ones that the tables don't take, and its counts (status, n)."""

    articles: DataFrame
    stores: DataFrame
    links: DataFrame
    crawls: DataFrame
    rejected: DataFrame
    counts: DataFrame


def skip_known(items: DataFrame, link: str, articles: DataFrame, url: str) -> DataFrame:
    """``items`` whose link is no article's url. Of the articles only those that the items name leave the scan."""
    return items.join(_known(items, link, articles, url), link, "left_anti")


def _known(items: DataFrame, link: str, articles: DataFrame, url: str) -> DataFrame:
    return articles.select(F.col(url).alias(link)).join(items.select(link).distinct(), link, "left_semi").distinct()


def new_items(items: DataFrame, sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Items, as feed_items gives them, of enabled sources' feeds that aren't known by their link yet, with their source.

    Rows: source_id, ordinal, link, title, published_at, rss_text, thumbnail, src_pref, src_city. Items without a link
    and feeds that can't be read give none.
    """
    on = sources.where("enabled").select(F.col("id").alias("source_id"), F.col("pref").alias("src_pref"), F.col("city").alias("src_city"))
    items = items.where("NOT broken AND link IS NOT NULL AND link != ''")
    raw = F.coalesce("html", F.lit(""))
    # exploded, so that a filter on the text reads it and doesn't make it once more for each of its patterns
    read = items.select("*", F.explode(F.array(html.strip_html(raw))).alias("rss_text")).join(on, "source_id")
    return read.join(_known(items, "link", articles, "article_url"), "link", "left_anti").select("source_id", "ordinal", "link", F.regexp_replace(F.coalesce("title", F.lit("")), rf"^[{text.WHITE}]+|[{text.WHITE}]+\z", "").alias("title"), published_at(F.col("published"), F.col("fetched_at")).alias("published_at"), "rss_text", html.first_image(raw).alias("thumbnail"), "src_pref", "src_city")


def first_of_link(items: DataFrame) -> DataFrame:
    """Of items with one link the first, by source and place in its feed."""
    rest = [c for c in items.columns if c != "link"]
    return items.groupBy("link").agg(F.min_by(F.struct(*rest), F.struct("source_id", "ordinal")).alias("item")).select("link", "item.*")


def with_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``items`` with content, the longer of the page's main text and the feed's, and thumbnail from either.

    Pages (url, html) may be missing; of several with one address the last by its text counts. Pages that no item
    links to don't leave the scan where the items are few enough to broadcast.
    """
    wanted = pages.select(F.col("url").alias("link"), F.col("html").alias("page")).join(items.select("link"), "link", "left_semi")
    mains = wanted.groupBy("link").agg(F.max("page").alias("page")).select("link", html.main_content(F.col("page")).alias("main"))
    found = items.join(mains, "link", "left")
    full = F.coalesce("main.text", F.lit(""))
    longer = F.when(text.utf16_length(full) > text.utf16_length(F.col("rss_text")), full).otherwise(F.col("rss_text"))
    image = F.coalesce(text.nonblank(F.col("thumbnail")), text.nonblank(F.col("main.thumbnail")), F.col("thumbnail"))
    return found.withColumn("content", longer).withColumn("thumbnail", image).drop("main", "rss_text")


def extracted(items: DataFrame) -> DataFrame:
    """``items`` with the fields of a store read from title and content."""
    both, year = F.concat("title", F.lit(" "), "content"), F.year("published_at")
    out = items.withColumn("addr", text.extract_address(both, F.col("src_pref")))
    out = out.withColumn("pref", F.coalesce(text.extract_pref(F.col("addr")), "src_pref"))
    return out.select(
        "*",
        F.coalesce(text.extract_city(F.col("addr"), F.col("pref")), "src_city", F.lit("")).alias("city"),
        text.extract_store_name(F.col("title")).alias("name"),
        text.extract_tel(F.col("content")).alias("tel"),
        text.extract_open_date(both, year).alias("opening"),
        text.extract_genre(F.col("content"), F.col("title")).alias("genre"),
        text.extract_station(both).alias("nearest_station"),
    ).withColumn("name_normalized", text.normalize_name(F.col("name"))).withColumn("addr_normalized", F.when(F.col("addr").isNotNull(), text.normalize_address(F.col("addr")))).withColumn("tel_normalized", text.normalize_tel(F.col("tel")))


def ingest(feeds: DataFrame, pages: DataFrame, sources: DataFrame, articles: DataFrame | Callable[[DataFrame], DataFrame], stores: DataFrame, now: Column, tops: tuple[int, int] | None = None, *, count_repeats: bool = False) -> Batch:
    """What a poll of ``feeds`` (source_id, xml, fetched_at) adds to the tables.

    ``articles`` are the known ones, or a function from the items' links (link) to those that may stand among them
    (article_url); ``tops`` are the largest ids of articles and stores that were given before, else those in the tables. With
    ``count_repeats`` an item whose link an earlier one has uses up an article's id, as a refused insert does.

    Order is by source id and place in the feed. Only the feed's text decides whether an item announces a place to eat;
    items that don't are forgotten and judged again next time. Every other one with a readable date becomes an
    article; of these, the ones with a name, a prefecture and a city that aren't a chain's become or join a store. A
    date of opening that the calendar lacks is null, and the item is listed in ``rejected`` with its reason, as are
    items without a readable date.
    """
    parsed = durable(feed_items(feeds))
    top_article, top_store = tops or (articles.agg(F.max("id")).first()[0] or 0, None)
    if callable(articles):
        articles = articles(parsed.where("link IS NOT NULL").select("link").distinct())
    items = new_items(parsed, sources, articles).where(text.is_food_opening(F.col("title"), F.col("rss_text")))
    order = [F.col("source_id"), F.col("ordinal")]
    if count_repeats:
        items = durable(items)
        places = numbered(items.where("published_at IS NOT NULL").select(*order), order, "article_id", top_article + 1)
        items = items.join(places, ["source_id", "ordinal"], "left")
    read = durable(extracted(with_pages(durable(first_of_link(items)), pages)))
    taken = read.where("published_at IS NOT NULL")
    if not count_repeats:
        taken = numbered(taken, order, "article_id", top_article + 1, written=True)
    new_articles = taken.select(F.col("article_id").alias("id"), "source_id", F.col("link").alias("article_url"), "title", F.substring("content", 1, CONTENT).alias("content"), F.col("thumbnail").alias("thumbnail_url"), "published_at", F.lit(None).cast("string").alias("raw_html"), F.lit(True).alias("parsed"), now.alias("created_at"))

    named = F.col("name").isNotNull() & (F.col("name") != "") & text.nonblank(F.col("pref")).isNotNull() & (F.col("city") != "")
    state = F.when(~F.coalesce(named, F.lit(False)), "incomplete").when(text.is_chain(F.col("name")), "chain").otherwise("candidate")
    # counted while they are written, not in a pass of their own
    told, made_of = Observation(), Observation()
    count = lambda column, *values: [F.count_if(F.col(column) == v).alias(v) for v in values]
    judged = durable(taken.withColumn("state", state).observe(told, *count("state", "incomplete", "chain")))
    found = resolve(judged.where("state = 'candidate'").withColumn("rank", F.col("article_id")), stores, first_id=None if top_store is None else top_store + 1)
    placed = durable(found.observe(made_of, *count("outcome", "merged", "soft", "new")))
    counted = {**told.get, "merged": made_of.get["merged"], "added": made_of.get["soft"] + made_of.get["new"]}
    made = placed.where("outcome != 'merged'")
    new_stores = made.select(
        F.col("store_id").alias("id"), "name", "name_normalized", "addr", "addr_normalized", "pref", "city", "tel", "tel_normalized", "genre",
        F.try_to_date("opening").alias("open_date"), F.to_date("published_at").alias("listed_date"), F.col("thumbnail").alias("thumbnail_url"),
        (F.col("outcome") == "soft").alias("duplicate_flag"), "duplicate_of_id", now.alias("created_at"), now.alias("updated_at"), "nearest_station",
    )
    links = placed.select("store_id", "article_id")
    crawled = parsed.where("NOT broken").select("source_id").distinct()
    reason = F.when(F.col("published_at").isNull(), "published_at").when(F.col("opening").isNotNull() & F.try_to_date("opening").isNull(), "open_date")
    rejected = read.select("source_id", "ordinal", "link", reason.alias("reason")).where("reason IS NOT NULL")
    counts = read.sparkSession.createDataFrame([(k, n) for k, n in counted.items() if n], "status string, n long")
    return Batch(new_articles, new_stores, links, crawled.select("source_id", now.alias("crawled_at")), rejected, counts)
