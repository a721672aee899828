"""What is dear is worked out once a row, and only for the rows that need it; and gives what the plain way gives."""

import re

import pytest
from pyspark.sql import functions as F

from kawara.functions import html, text, words
from kawara.plans import ingest, maintain
from kawara.sources import feeds


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(spark, schema):
    return spark.createDataFrame([], schema).repartition(2)  # not folded away as empty


def test_feeds_are_parsed_once_and_once_more_where_broken(spark):
    given = rows_of(spark, "source_id long, xml string")
    assert planned(feeds.feed_items(given)).count("from_xml(") == 2


def test_broken_feeds_beside_whole_ones(spark):
    item = "<rss><channel><item><title>a</title><link>x</link></item><item><title>b</title></item></channel></rss>"
    given = [(1, item), (2, "<rss>"), (3, None), (4, "<rss><channel></channel></rss>"), (5, item.replace(">a<", ">a & b<"))]
    out = feeds.feed_items(spark.createDataFrame(given, "source_id long, xml string"))
    assert out.columns == ["source_id", "ordinal", "title", "link", "published", "html", "broken"]
    found = {(r.source_id, r.ordinal, r.title, r.link, r.broken) for r in out.collect()}
    assert found == {(1, 0, "a", "x", False), (1, 1, "b", None, False), (2, None, None, None, True), (3, None, None, None, True), (5, 0, "a & b", "x", False), (5, 1, "b", None, False)}


def test_item_texts_are_stripped_once(spark):
    items = rows_of(spark, "source_id long, fetched_at timestamp, ordinal int, title string, link string, published string, html string, broken boolean")
    sources, known = rows_of(spark, "id long, enabled boolean, pref string, city string"), rows_of(spark, "article_url string")
    plan = planned(ingest.new_items(items, sources, known).where(text.is_food_opening(F.col("title"), F.col("rss_text"))))
    assert plan.count("!--.*?--") == 1


def test_genres_are_read_after_the_join(spark):
    plan = planned(maintain.reclassified(rows_of(spark, "id long, genre string"), rows_of(spark, "store_id long, article_id long"), rows_of(spark, "id long, title string, content string")))
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.split("\n")
    read = [i for i, line in enumerate(lines) if "焼鳥" in line]
    assert len(read) == 1  # once, and above a join of the links with the articles
    assert any("Join" in line and depth(line) > depth(lines[read[0]]) for line in lines[read[0] + 1 :])


@pytest.mark.parametrize("ws", [words.NON_FOOD, words.FOOD, words.TITLE_OPENINGS, words.CHAINS, ["100均", "café", "]a", "^b", "BAR"]])
def test_words_are_tried_only_where_one_may_begin(spark, ws):
    given = [w for w in ws] + ["x" + w + "。" for w in ws] + [w[:-1] for w in ws] + ["", "zzz ^ ] é 一", "qz~"]
    out = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.any_of(F.col("t"), ws).alias("found")).collect()
    assert [r.found for r in out] == [any(w in t for w in ws) for t in given]
    plan = rows_of(spark, "t string").select(text.any_of(F.col("t"), ws).alias("v"))._jdf.queryExecution().analyzed().toString()
    pattern = re.search(r"RLIKE\(t#\d+, (.*?)\) AS v", plan, re.S).group(1)
    look = re.match(r"\(\?=\[.*?(?<!\\)\]\)", pattern).group(0)
    firsts = {w[0] for w in ws}
    assert not [c for c in map(chr, range(33, 127)) if c not in firsts and re.match(look, c)]


def test_most_frequent_label_in_any_script(spark):
    lists = {"a": ["Pizza", "ピッツァ"], "b": ["café", "珈琲"], "c": ["ドミノ・ピザ"], "d": ["焼き鳥", "炭火焼き鳥"]}
    given = ["Pizzaピッツァ café", "caféと珈琲と珈琲 Pizza", "ドミノ・ピザ", "炭火焼き鳥 Pizza", "none", "", None, "珈x琲 珈 琲", "ピッツァPizza珈琲café"]
    out = [r.v for r in spark.createDataFrame([(t,) for t in given], "t string").select(text.best_label(F.col("t"), lists).alias("v")).collect()]

    def plain(t):
        counts = [sum((t or "").count(w) for w in ws) for ws in lists.values()]
        return list(lists)[counts.index(max(counts))] if max(counts) else None

    assert out == [plain(t) for t in given]


def test_white_space_and_entities(spark):
    given = {"a  b": "a b", "a b": "a b", " a\n　b ": "a b", "é é  é": "é é é", "a é": "a é", "<b>a</b>&amp;lt;<!-- x > y -->&lt;c": "a&lt;<c", "a < b": "a < b", "<!doctype x>t": "t", "": ""}
    out = spark.createDataFrame([(t,) for t in given], "t string").select(html.strip_html(F.col("t")).alias("v")).collect()
    assert [r.v for r in out] == list(given.values())


def test_pages_of_items(spark):
    items = spark.createDataFrame([("x", "short", None), ("y", "a longer text than the page has", "t.png"), ("z", "z", None)], "link string, rss_text string, thumbnail string")
    pages = spark.createDataFrame([("x", "<body><p>a text that is longer</p><img src='i.png'></body>"), ("y", "<body>page</body>"), ("other", "<body>never</body>"), ("z", None)], "url string, html string")
    out = {r.link: (r.content, r.thumbnail) for r in ingest.with_pages(items, pages).collect()}
    assert out == {"x": ("a text that is longer", "i.png"), "y": ("a longer text than the page has", "t.png"), "z": ("z", None)}
