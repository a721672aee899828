"""Feeds to catalogue: parsing, one batch, and polls that run again."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from kawara.plans import ingest, maintain, views
from kawara.operators.serving import Filters
from kawara.sources import feeds
from kawara.sources.schema import SCHEMAS, Tables, quarantine
from kawara.streaming import poll

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>x</title>%s</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>「喫茶ひなた」オープン</title><link rel="edit" href="https://e/"/><link href="https://atom/1"/><published>2026-04-20T10:00:00+09:00</published><content type="html">喫茶店です</content></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>c</title></channel><item><title>r</title><link>https://rdf/1</link><description>d</description></item></rdf:RDF>"""


def item(title, link, date="Wed, 22 Apr 2026 09:00:00 +0900", html="", encoded=None):
    body = f"<content:encoded><![CDATA[{encoded}]]></content:encoded>" if encoded else ""
    return f"<item><title>{title}</title><link>{link}</link>{f'<pubDate>{date}</pubDate>' if date else ''}<description><![CDATA[{html}]]></description>{body}</item>"


def rss(*items):
    return RSS % "".join(items)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, datetime(2026, 4, 23)) for i, x in rows], "source_id long, xml string, fetched_at timestamp")


def test_feed_items(spark):
    got = feeds.feed_items(frame(spark, [(1, rss(item("a & b &amp; c", "https://u/1", html="<img src='i.png'>d", encoded="<p>e</p>"), item("t", "", None))), (2, ATOM), (3, RDF), (4, "no feed <"), (5, None), (6, rss())])).orderBy("source_id", "ordinal").collect()
    assert [(r.source_id, r.ordinal, r.title, r.link, r.html, r.broken) for r in got] == [
        (1, 0, "a & b & c", "https://u/1", "<p>e</p>", False),
        (1, 1, "t", None, "", False),
        (2, 0, "「喫茶ひなた」オープン", "https://atom/1", "喫茶店です", False),
        (3, 0, "r", "https://rdf/1", "d", False),
        (4, None, None, None, None, True),
        (5, None, None, None, None, True),
    ]
    counts = {r.source_id: r.items for r in feeds.item_counts(frame(spark, [(1, rss(item("a", "b"))), (2, rss()), (3, "<")]), "source_id").collect()}
    assert counts == {1: 1, 2: 0, 3: -1}


def test_ampersands(spark):
    assert spark.createDataFrame([("a & b &amp; &#12; &x",)], "t string").select(feeds.escape_ampersands(F.col("t"))).first()[0] == "a &amp; b &amp; &#12; &amp;x"


def test_dates(spark):
    rows = [("Wed, 22 Apr 2026 09:00:00 +0900", "2026-04-22 00:00:00"), ("22 Apr 2026 09:00 GMT", "2026-04-22 09:00:00"), ("2026-04-22T09:00:00Z", "2026-04-22 09:00:00"), (None, "2026-01-01 00:00:00"), (" ", "2026-01-01 00:00:00"), ("soon", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    out = df.select(feeds.published_at(F.col("t"), F.lit("2026-01-01").cast("timestamp")).cast("string").alias("got"), "want").collect()
    assert all(r.got == r.want for r in out), out


def test_templates(spark):
    rows = spark.createDataFrame([("号外NET", "koto", "江東区", "東京都", "江東区", None, None, None), ("経済新聞", "ginza", "銀座", "東京都", None, None, None, None), ("独立系ブログ", None, None, "千葉県", "市川市", "blog", "https://b/", "https://b/feed")], "source_type string, sub string, label string, pref string, city string, name string, url string, rss_url string")
    assert [tuple(r)[:3] for r in feeds.templated_sources(rows).collect()] == [("号外NET 江東区", "https://koto.goguynet.jp/", "https://koto.goguynet.jp/category/cat_openclose/feed/"), ("銀座経済新聞", "https://ginza.keizai.biz/", "https://ginza.keizai.biz/rss.xml"), ("blog", "https://b/", "https://b/feed")]


SOURCES = [(1, "s1", "https://s1/", None, "独立系ブログ", "東京都", "北区", True), (2, "s2", "https://s2/", None, "経済新聞", "千葉県", None, True), (3, "off", "https://s3/", None, "経済新聞", "千葉県", None, False)]
FEEDS = [
    (1, rss(
        item("ラーメン「麺屋さくら」オープン", "https://a/1", html="電話 03-1234-5678 東京都北区赤羽1-2-3 2026年5月1日オープン<img src='f.png'>"),
        item("ラーメン「さくら二号」オープン", "https://a/2", html="電話 03-1234-5678"),
        item("ラーメン「さくら二号」開店", "https://a/3", html="とんこつ"),
        item("美容室オープン", "https://a/4"),
        item("「スターバックス北区店」オープン、カフェ", "https://a/5"),
        item("「喫茶ひなた」オープン", "https://a/6", "not a date"),
        item("カフェ「Alpha Beta」オープン", "https://a/7", html="2026年13月45日オープン"),
        item("カフェ「alpha-x」オープン", "https://a/8"),
        item("「喫茶ひなた」オープン", ""),
    )),
    (2, rss(item("ラーメン「麺屋さくら」オープン", "https://a/1", html="再掲"), item("「喫茶よそ」オープン", "https://b/1", html="どこか"))),
    (3, rss(item("「喫茶おふ」オープン", "https://c/1"))),
]
PAGES = [("https://a/2", "<body><article>" + "長い本文。" * 60 + "<img src='p.png'></article></body>"), ("https://zzz/", "<p>")]


def tables(spark, folder):
    out = Tables(spark, str(folder)).create()
    rows = spark.createDataFrame(SOURCES, "id long, name string, url string, rss_url string, source_type string, pref string, city string, enabled boolean")
    out.append("sources", rows.where("id < 3").withColumn("last_crawled_at", F.lit(None).cast("timestamp")).withColumn("created_at", F.current_timestamp()), -1)
    out.seed(rows.where("id > 1").drop("id"))
    return out


def test_one_batch(spark, tmp_path):
    t = tables(spark, tmp_path)
    pages = spark.createDataFrame(PAGES, "url string, html string")
    out = ingest.ingest(frame(spark, FEEDS), pages, t.sources(), t.read("articles"), t.read("stores"), F.lit("2026-04-23").cast("timestamp"))
    articles = {r.article_url: r for r in out.articles.collect()}
    assert sorted(articles) == ["https://a/1", "https://a/2", "https://a/3", "https://a/5", "https://a/7", "https://a/8", "https://b/1"]
    assert sorted(r.id for r in articles.values()) == list(range(1, 8))
    assert articles["https://a/1"].source_id == 1 and articles["https://a/1"].thumbnail_url == "f.png"
    assert articles["https://a/2"].content.startswith("長い本文") and articles["https://a/2"].thumbnail_url == "p.png"
    assert articles["https://a/1"].published_at == datetime(2026, 4, 22)
    stores = {r["name"]: r for r in out.stores.collect()}
    # the page of a/2 replaced the feed's text, and with it the phone number: a store of its own, which a/3 joins
    assert sorted(stores) == ["Alpha Beta", "alpha-x", "さくら二号", "麺屋さくら"]
    sakura = stores["麺屋さくら"]
    assert (sakura.addr, sakura.city, sakura.tel, str(sakura.open_date), sakura.genre, sakura.tel_normalized) == ("東京都北区赤羽1-2-3", "北区", "0312345678", "2026-05-01", "ラーメン", "0312345678")
    assert not any(r.duplicate_flag for r in stores.values())
    links = {(r.store_id, r.article_id) for r in out.links.collect()}
    assert (stores["さくら二号"].id, articles["https://a/3"].id) in links and len(links) == 5
    assert {(r.link, r.reason) for r in out.rejected.collect()} == {("https://a/6", "published_at"), ("https://a/7", "open_date")}
    assert {r.status: r.n for r in out.counts.collect()} == {"added": 4, "merged": 1, "chain": 1, "incomplete": 1}
    assert {r.source_id for r in out.crawls.collect()} == {1, 2, 3}
    good, bad = quarantine(out.stores, "stores")
    assert good.count() == 4 and bad.count() == 0


def test_repeats_use_up_ids(spark):
    sources = spark.createDataFrame([(1, "東京都", "北区", True), (2, "東京都", "北区", True)], "id long, pref string, city string, enabled boolean")
    rows = [(1, rss(*[item("ラーメン「店」オープン", f"https://a/{k}", "soon" if k == 4 else None) for k in (1, 2, 1, 4, 3)])), (2, rss(*[item("ラーメン「店」オープン", f"https://a/{k}", None) for k in (2, 4, 5)]))]
    nothing = lambda t: spark.createDataFrame([], SCHEMAS[t])
    for count, want in ((True, {1: 1, 2: 2, 3: 4, 5: 7}), (False, {1: 1, 2: 2, 3: 3, 5: 4})):
        out = ingest.ingest(frame(spark, rows), spark.createDataFrame([], "url string, html string"), sources, nothing("articles"), nothing("stores"), F.lit("2026-04-23").cast("timestamp"), count_repeats=count)
        assert {int(r.article_url[-1]): r.id for r in out.articles.collect()} == want


def test_polls_are_idempotent(spark, tmp_path):
    t = tables(spark, tmp_path / "tables")
    pages = spark.createDataFrame(PAGES, "url string, html string")
    frame(spark, FEEDS[:1]).write.mode("append").parquet(str(tmp_path / "feeds"))
    run = lambda check: poll.poll(spark, str(tmp_path / "feeds"), pages, t, str(tmp_path / check)).awaitTermination()
    run("c")
    once = {n: sorted(map(str, t.read(n).collect())) for n in ("articles", "stores", "store_articles")}
    assert len(once["articles"]) == 6 and len(once["stores"]) == 4
    frame(spark, FEEDS).write.mode("append").parquet(str(tmp_path / "feeds"))
    run("c")
    assert t.read("articles").count() == 7 and t.read("stores").count() == 4 and set(once["stores"]) <= set(map(str, t.read("stores").collect()))
    run("c")
    assert t.read("articles").count() == 7
    assert t.sources().where("last_crawled_at IS NOT NULL").count() == 3
    served = views.serve(t.read("stores"), t.read("store_articles"), t.read("articles"), t.sources(), Filters(pinned_pref="東京都"), F.lit("2026-04-23").cast("date")).collect()
    assert [len(r.sources) for r in served].count(2) == 1 and {r.pref for r in served} == {"東京都"}
    assert maintain.audit(t.read("stores")).first().asDict() == {"n": 4, "n_addr": 1, "n_station": 0, "n_tel": 1, "n_suspicious": 0, "addr_percent": 25, "station_percent": 0, "tel_percent": 25}


def test_append_new(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(i % 7, i) for i in range(n)], "id long, at long")
    rows(10).write.parquet(str(tmp_path / "in"))
    run = lambda check, first: poll.append_new(spark.readStream.schema("id long, at long").parquet(str(tmp_path / "in")), "id", "at", str(tmp_path / "out"), str(tmp_path / check), first_batch=first).awaitTermination()
    run("a", 0)
    run("b", 100)
    got = sorted((r.id, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(i, i) for i in range(7)]


def test_reclassify(spark):
    stores = spark.createDataFrame([(1, "a", None), (2, "b", "ラーメン"), (3, "c", "寿司"), (4, "d", None)], "id long, name string, genre string")
    articles = spark.createDataFrame([(1, "ラーメン店", ""), (2, "t", "寿司と鮨"), (3, "t", "なし")], "id long, title string, content string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "store_id long, article_id long")
    assert {r.id: r.genre for r in maintain.reclassify(stores, links, articles, F.current_timestamp()).collect()} == {1: "ラーメン", 2: "寿司", 3: "寿司", 4: None}
