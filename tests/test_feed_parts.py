"""The feeds that feed_items writes stay bounded."""

from pyspark.sql import functions as F

from kawara import catalog


def test_no_feed_grows_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(2500).select(F.col("id").alias("page_id"), F.format_string("https://x/%d", "id").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    seen, whole = [], catalog.feeds.feed_items
    monkeypatch.setattr(catalog.feeds, "feed_items", lambda df: seen.append(df) or whole(df))
    got = sorted((r.source_id, r.ordinal, r.title) for r in catalog.QUERIES["feed_items"](spark, str(tmp_path)).where("NOT broken").collect())
    assert got == sorted((i % 10, i // 10, f"T&{i}") for i in range(2500))
    assert max(r.xml.count("<item>") for r in seen[0].collect()) == 100
