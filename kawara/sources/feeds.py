"""Feeds (RSS 2.0, RSS 1.0, Atom) as rows of items, and sources made from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank

_LINK = "array<struct<_VALUE string, _href string, _rel string>>"
_ITEM = f"struct<title string, link {_LINK}, pubDate string, published string, updated string, description string, summary string, content string, `content:encoded` string, `media:thumbnail` struct<_url string>>"
_FEED = f"channel struct<item array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>, broken string"

#: Source families whose addresses follow from a short name (fixed values): url, feed, type, and how the name is made.
TEMPLATES = {
    "号外NET": ("https://%s.goguynet.jp/", "https://%s.goguynet.jp/category/cat_openclose/feed/", "号外NET %s"),
    "経済新聞": ("https://%s.keizai.biz/", "https://%s.keizai.biz/rss.xml", "%s経済新聞"),
}


def templated_sources(rows: DataFrame) -> DataFrame:
    """Sources from rows of (source_type, sub, label, pref, city); those of other types keep their own name, url and rss_url."""
    kind = F.col("source_type")
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")

    def made(i: int, arg: str, otherwise: str) -> Column:
        out = own(otherwise)
        for family, parts in TEMPLATES.items():
            out = F.when(kind == family, F.format_string(parts[i], F.col(arg))).otherwise(out)
        return out

    return rows.select(made(2, "label", "name").alias("name"), made(0, "sub", "url").alias("url"), made(1, "sub", "rss_url").alias("rss_url"), kind, "pref", "city")


def escape_ampersands(xml: Column) -> Column:
    """Every ampersand that begins no entity, written as one."""
    return F.regexp_replace(xml, r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#\d+|#x[0-9a-fA-F]+);)", "&amp;")


def feed_items(feeds: DataFrame, *, xml_col: str = "xml") -> DataFrame:
    """One row an item, with the feed's other columns: ordinal (from 0, in the feed's order), title, link, published, html.

    A feed that doesn't parse is parsed once more with its bare ampersands escaped; what then still fails, or is null,
    gives one row without an ordinal and with broken = true. An empty feed gives no row. ``published`` is the text of
    the date; ``html`` is the encoded content, else the content or description.
    """
    kept = [c for c in feeds.columns if c != xml_col]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    xml = F.regexp_replace(F.col(xml_col), r"^[\s﻿]+", "")
    bad = F.col("feed").isNull() | F.col("feed.broken").isNotNull()
    again = F.when(bad, F.from_xml(escape_ampersands(xml), _FEED, options)).otherwise(F.col("feed"))
    # exploded, so that filters don't move below and parse once more
    parsed = feeds.select("*", F.explode(F.array(F.from_xml(xml, _FEED, options))).alias("feed")).select(*kept, F.explode(F.array(again)).alias("feed")).withColumn("broken", bad)
    items = F.concat(*[F.coalesce(x, F.array().cast(f"array<{_ITEM}>")) for x in (F.col("feed.channel.item"), F.col("feed.item"), F.col("feed.entry"))])
    told = F.when(F.col("broken"), F.array(F.lit(None).cast(_ITEM))).otherwise(items)
    whole = parsed.select(*kept, "broken", F.posexplode(told).alias("ordinal", "item"))
    link = lambda l: F.coalesce(nonblank(F.trim(l["_VALUE"])), l["_href"])
    alternate = F.filter("item.link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return whole.select(
        *kept,
        F.when(~F.col("broken"), F.col("ordinal")).alias("ordinal"),
        F.col("item.title").alias("title"),
        F.coalesce(F.try_element_at(F.transform(alternate, link), F.lit(1)), F.try_element_at(F.transform("item.link", link), F.lit(1))).alias("link"),
        F.coalesce("item.pubDate", "item.published", "item.updated").alias("published"),
        F.coalesce(F.col("item.`content:encoded`"), F.col("item.content"), F.col("item.description"), F.col("item.summary")).alias("html"),
        "broken",
    )


def item_counts(feeds: DataFrame, key: str) -> DataFrame:
    """Items of each feed; -1 where it couldn't be read."""
    items = feed_items(feeds).groupBy(key).agg(F.max("broken").alias("broken"), F.count("*").alias("n"))
    n = F.when(F.col("broken"), -1).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return feeds.select(key).distinct().join(items, key, "left").select(key, n.alias("items"))


def published_at(text: Column, otherwise: Column) -> Column:
    """A feed's date, ISO 8601 or RFC 822; ``otherwise`` where there is none, null where it can't be read."""
    given = nonblank(F.trim(text))
    plain = F.regexp_replace(F.regexp_replace(given, r"^[A-Za-z]{3,9},?\s+", ""), r"\s(?:GMT|UTC?|Z)$", " +0000")
    plain = F.regexp_replace(plain, r"\sJST$", " +0900")
    read = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")], F.try_to_timestamp(given))
    return F.when(given.isNull(), otherwise).otherwise(read)
