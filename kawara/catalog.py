"""Every registered query of the feed-to-catalogue engine and the SQL that it is held against.

The driver's tables stand in for the catalogue's: customers are stores, orders are articles and link to them, nations
are sources. Texts in Japanese, which those tables lack, come as literal rows to both sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dictionary, html, sql, text, words
from .operators import changes, resolve, similar
from .operators import serving as pages_of
from .operators.durable import numbered, shared_folder
from .operators.serving import Filters
from .plans import ingest, maintain, pages, views
from .plans import served as served_view
from .sources import feeds
from .sources.schema import SCHEMAS, Tables, quarantine
from .streaming import poll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TODAY = "2024-02-01"


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and its SQL where SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _today() -> Column:
    return F.lit(TODAY).cast("date")


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# ---- the catalogue's tables made from the driver's


def sources(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    listed = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return _read(spark, d, "nation").select(key.alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")).alias("url"), listed(words.SOURCE_TYPES, F.col("n_regionkey")).alias("source_type"), (key % 6 != 0).alias("enabled"), listed(words.PREFS, key % 7).alias("pref"), F.when(key % 5 != 0, F.col("n_name")).alias("city"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, d, "orders").select(key.alias("id"), (key % 25).alias("source_id"), F.concat(F.lit("https://news.example/"), key.cast("string")).alias("article_url"), F.concat_ws(" ", "o_orderpriority", key.cast("string")).alias("title"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"), F.col("o_orderdate").alias("published_at"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select(F.col("o_custkey").alias("store_id"), F.col("o_orderkey").alias("article_id"))


def stores(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    tel = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("03"), F.lpad(key.cast("string"), 8, "0")))
    rows = _read(spark, d, "customer").join(_read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(key % 3 != 0, F.concat_ws(" ", "n_name", key.cast("string"))).alias("addr"),
        F.element_at(F.array(*[F.lit(p) for p in words.PREFS]), (key % 7 + 1).cast("int")).alias("pref"),
        F.col("n_name").alias("city"),
        tel.alias("tel"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("genre"),
        F.when(key % 5 == 0, F.concat("n_name", F.lit("駅"))).alias("nearest_station"),
        F.when(key % 4 != 0, day(key % 60)).alias("open_date"),
        day(key * 7 % 40).alias("listed_date"),
        F.lit(None).cast("string").alias("thumbnail_url"),
        (key % 50 == 0).alias("duplicate_flag"),
        F.when(key % 50 == 0, key - 1).alias("duplicate_of_id"),
    )


def served(spark: SparkSession, d: str) -> DataFrame:
    return views.serving_rows(views.stores_with_sources(stores(spark, d), links(spark, d), articles(spark, d), sources(spark, d)))


_PREFS, _TYPES = f"[{_quoted(words.PREFS)}]", f"[{_quoted(words.SOURCE_TYPES)}]"
_TABLES = f"""WITH sources AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, 'https://' || lower(n_name) || '.example/' AS url, ({_TYPES})[n_regionkey + 1] AS source_type,
  n_nationkey % 6 <> 0 AS enabled, ({_PREFS})[n_nationkey % 7 + 1] AS pref, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS city FROM nation),
articles AS (SELECT o_orderkey AS id, o_orderkey % 25 AS source_id, 'https://news.example/' || o_orderkey AS article_url, o_orderpriority || ' ' || o_orderkey AS title,
  o_orderstatus || ' ' || o_orderpriority AS content, o_orderdate AS published_at FROM orders),
links AS (SELECT o_custkey AS store_id, o_orderkey AS article_id FROM orders),
stores AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN n_name || ' ' || c_custkey END AS addr, ({_PREFS})[c_custkey % 7 + 1] AS pref, n_name AS city,
  CASE WHEN c_acctbal >= 0 THEN '03' || lpad(c_custkey::VARCHAR, 8, '0') END AS tel, nullif(c_mktsegment, 'MACHINERY') AS genre, CASE WHEN c_custkey % 5 = 0 THEN n_name || '駅' END AS nearest_station,
  CASE WHEN c_custkey % 4 <> 0 THEN DATE '2024-01-01' + (c_custkey % 60)::INT END AS open_date, DATE '2024-01-01' + (c_custkey * 7 % 40)::INT AS listed_date, NULL::VARCHAR AS thumbnail_url,
  c_custkey % 50 = 0 AS duplicate_flag, CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 1 END AS duplicate_of_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
told AS (SELECT l.store_id, a.id, a.title, a.published_at, s.name, a.article_url AS url, s.source_type AS type FROM links l JOIN articles a ON a.id = l.article_id LEFT JOIN sources s ON s.id = a.source_id),
served AS (SELECT s.id::VARCHAR AS id, s.name, t.article_title, coalesce(addr, '') AS addr, pref, city, listed_date AS date, coalesce(open_date::VARCHAR, '') AS open_date, coalesce(genre, '{words.OTHER_GENRE}') AS genre,
  coalesce(tel, '') AS tel, nearest_station, '' AS thumb, coalesce(t.sources, '[]') AS sources, duplicate_flag, CASE WHEN duplicate_of_id <> 0 THEN duplicate_of_id::VARCHAR END AS duplicate_of_id
  FROM stores s LEFT JOIN (SELECT store_id, arg_max(title, (published_at, id)) AS article_title, to_json(list({{'name': name, 'url': url, 'type': type}} ORDER BY published_at DESC, id DESC)) AS sources FROM told GROUP BY store_id) t ON t.store_id = s.id)
"""
_WHITE = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _sql_squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{_WHITE}]+', ' ', 'g'))"


def _sql_normal(t: str) -> str:
    return _sql_squeeze(f"translate(coalesce({t}, ''), '{text._WIDE}', '{text._NARROW}')")


def _sql_name(t: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace({_sql_normal(t)}, '[（(].*?[)）]', '', 'g'), '株式会社|有限会社|合同会社', '', 'g'), '[{_WHITE}]+', '', 'g'))"


def _sql_any(t: str, parts: list[str]) -> str:
    return f"coalesce(regexp_matches({t}, '{'|'.join(re.escape(p) for p in parts)}'), false)"


def _json(column: str) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


# ---- the first slice: normalise, find the leader, gather, filter, order


@query(f"""WITH k AS (SELECT *, {_sql_name('text')} AS key FROM documents)
SELECT min(doc_id) AS doc_id, count(*) AS copies, to_json(list_sort(list(DISTINCT source))) AS sources, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS position
FROM k WHERE lang = 'en' GROUP BY key""")
def catalogue_slice(spark, d):
    """Documents of one language by their normalised text: leader, copies and sources, most copied first."""
    rows = _read(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", F.sha2(text.normalize_name(F.col("text")), 256).alias("key"))
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.to_json(F.array_sort(F.collect_set("source"))).alias("sources"))
    return numbered(groups.drop("key"), [F.desc("copies"), F.asc("doc_id")], "position")


# ---- views and serving


@query(_TABLES + """SELECT s.id, s.name, (SELECT arg_max(title, (published_at, id)) FROM told WHERE store_id = s.id) AS article_title,
coalesce((SELECT to_json(list({'name': t.name, 'url': url, 'title': title, 'type': type} ORDER BY published_at DESC, t.id DESC)) FROM told t WHERE store_id = s.id), '[]') AS sources FROM stores s""")
def stores_with_sources_json(spark, d):
    out = views.stores_with_sources(stores(spark, d), links(spark, d), articles(spark, d), sources(spark, d))
    return out.select("id", "name", "article_title", _json("sources").alias("sources"))


@query(_TABLES + "SELECT store_id, arg_max(title, (published_at, id)) AS article_title FROM told GROUP BY store_id")
def latest_article_title(spark, d):
    return views.latest_titles(links(spark, d), articles(spark, d))


@query(_TABLES + "SELECT id, name, '[]' AS sources FROM stores WHERE id NOT IN (SELECT store_id FROM told WHERE title LIKE '1-URGENT%')")
def unlinked_entities(spark, d):
    """Stores of which no urgent article tells."""
    out = views.stores_with_sources(stores(spark, d), links(spark, d), articles(spark, d).where("title LIKE '1-URGENT%'"), sources(spark, d))
    return out.where(F.size("sources") == 0).select("id", "name", _json("sources").alias("sources"))


@query(_TABLES + "SELECT s.id, s.duplicate_of_id, o.name AS original_name FROM stores s LEFT JOIN stores o ON o.id = s.duplicate_of_id")
def duplicate_originals(spark, d):
    return views.with_originals(stores(spark, d)).select("id", "duplicate_of_id", "original_name")


@query(_TABLES + "SELECT * FROM served")
def serving_rows(spark, d):
    return served(spark, d).withColumn("sources", _json("sources"))


@query(_TABLES + f"""SELECT id AS key, coalesce(nullif(article_title, ''), name) AS heading, CASE WHEN article_title <> name THEN name END AS shop, '{words.OTHER_COLOUR}' AS colour, genre,
'掲載 ' || strftime(date, '%m/%d') AS badge, CASE WHEN open_date = '' THEN NULL WHEN n > 0 THEN '🎉 ' || md || ' オープン予定（あと' || n || '日）' WHEN n = 0 THEN '🎉 本日 ' || md || ' オープン！' WHEN n >= -7 THEN '🎉 ' || md || ' オープン（' || -n || '日前）' ELSE '🎉 ' || md || ' オープン' END AS opening,
CASE WHEN addr <> '' THEN addr WHEN nearest_station IS NOT NULL THEN '🚃 最寄: ' || nearest_station ELSE '住所未抽出' END AS place, CASE WHEN addr <> '' THEN '🚃 最寄: ' || nearest_station END AS station,
CASE WHEN tel = '' THEN '電話番号記載なし' ELSE '📞 ' || tel END AS phone, sources->0->>'name' AS source, sources->0->>'url' AS link, CASE WHEN json_array_length(sources) > 1 THEN '+' || (json_array_length(sources) - 1) || '件' END AS more
FROM (SELECT *, date_diff('day', DATE '{TODAY}', try_cast(nullif(open_date, '') AS DATE)) AS n, replace(substr(open_date, 6), '-', '/') AS md FROM served)""")
def cards(spark, d):
    return pages_of.cards(served(spark, d), _today())


def _matching(spark: SparkSession, d: str, f: Filters, hidden: DataFrame | None = None) -> DataFrame:
    return views.matching(stores(spark, d), links(spark, d), articles(spark, d), sources(spark, d), f, _today(), hidden)


def _filtered(name: str, f: Filters, condition: str) -> None:
    @query(_TABLES + f"SELECT id, date, sources FROM served WHERE {condition}", name)
    def run(spark, d):
        return _matching(spark, d, f).select("id", "date", _json("sources").alias("sources"))


for _n in (3, 7, 30):
    _filtered(f"filter_recency_{_n}", Filters(within_days=_n), f"date >= DATE '{TODAY}' - {_n}")
_filtered("filter_pinned_pref", Filters(pref="東京都", pinned_pref="千葉県"), "pref = '千葉県'")
_filtered("filter_any_source_type", Filters(source_type="経済新聞"), "list_contains(json_extract_string(sources, '$[*].type'), '経済新聞')")
_filtered("filter_any_source_name", Filters(source_name="NATION_3"), "list_contains(json_extract_string(sources, '$[*].name'), 'NATION_3')")
_filtered("filter_contactable", Filters(require_tel=True, require_addr=True), "tel <> '' AND addr <> ''")
_filtered("filter_conjunction", Filters(pref="東京都", genre="BUILDING", within_days=30, require_tel=True, source_type="号外NET"), f"pref = '東京都' AND genre = 'BUILDING' AND date >= DATE '{TODAY}' - 30 AND tel <> '' AND list_contains(json_extract_string(sources, '$[*].type'), '号外NET')")

@query(_TABLES + f"SELECT id, article_title, sources, row_number() OVER (ORDER BY date DESC, id::BIGINT) AS position FROM served WHERE pref = '千葉県' AND city <> '' AND date >= DATE '{TODAY}' - 7")
def serve_page(spark, d):
    """A page of one prefecture, from the tables to numbered rows."""
    rows = views.serve(stores(spark, d), links(spark, d), articles(spark, d), sources(spark, d), Filters(pinned_pref="千葉県", within_days=7), _today())
    return numbered(rows, pages_of.order_keys("date-desc"), "position").select("id", "article_title", _json("sources").alias("sources"), "position")


_HIDDEN = '["1","5","9","77","nobody"]'


def _hidden(spark):
    return pages_of.hidden_ids(spark.createDataFrame([(_HIDDEN,), ("broken",)], "hidden string"))


@query(_TABLES + "SELECT id, name FROM served WHERE id NOT IN ('1', '5', '9', '77', 'nobody')")
def filter_hidden(spark, d):
    return _matching(spark, d, Filters(), _hidden(spark)).select("id", "name")


@query(_TABLES + "SELECT count(*) AS n FROM served WHERE id IN ('1', '5', '9', '77', 'nobody')")
def hidden_count(spark, d):
    return pages_of.hidden_count(served(spark, d), _hidden(spark))


@query(_TABLES + f"SELECT pref, count(*) AS n FROM served WHERE date >= DATE '{TODAY}' - 7 GROUP BY pref")
def filtered_counts(spark, d):
    return maintain.count_by(_matching(spark, d, Filters(within_days=7)))


def _ordered(name: str, order: str, keys: str) -> None:
    @query(_TABLES + f"SELECT id, row_number() OVER (ORDER BY {keys}, id::BIGINT) AS position FROM served", name)
    def run(spark, d):
        rows = served(spark, d).select("id", "date", "open_date", "genre", "pref")
        return numbered(rows, pages_of.order_keys(order), "position").select("id", "position")


_ordered("sort_date_desc", "date-desc", "date DESC")
_ordered("sort_date_asc", "date-asc", "date")
_ordered("sort_open_desc", "open-desc", "nullif(open_date, '') DESC NULLS LAST, date DESC")
_ordered("sort_open_asc", "open-asc", "nullif(open_date, '') NULLS LAST, date DESC")
_ordered("sort_collated", "genre", "genre, date DESC")
_ordered("sort_rank_list", "pref", f"list_position({_PREFS}, pref), date DESC")


def _facet(name: str, facet: str, sql: str, pref: str = "") -> None:
    @query(_TABLES + f"SELECT value, row_number() OVER (ORDER BY value) AS position FROM (SELECT DISTINCT {sql})", name)
    def run(spark, d):
        return views.facets(stores(spark, d), links(spark, d), articles(spark, d), sources(spark, d), pref).where(F.col("facet") == facet).select("value", "position")


_facet("facet_city_by_pref", "city", "city AS value FROM served WHERE pref = '東京都'", "東京都")
_facet("facet_genre", "genre", "genre AS value FROM served")
_facet("facet_nested_sources", "source", "name AS value FROM told WHERE store_id IN (SELECT id FROM stores)")

#: Genres with a colour of their own and one without, in the Japanese order: kana by sound, then kanji by their place in JIS X 0208.
_LISTED = ["イタリアン", "カフェ", "そば", "タイ料理", "フレンチ", "ラーメン", "沖縄料理", "海鮮", "居酒屋", "寿司", "焼肉", "中華", "和菓子"]


def _listed(spark, d):
    genre = F.element_at(F.array(*[F.lit(g) for g in _LISTED]), (F.col("id") * 5 % len(_LISTED) + 1).cast("int"))
    return served(spark, d).withColumn("genre", genre)


@query(_TABLES + f"SELECT id, row_number() OVER (ORDER BY id::BIGINT * 5 % {len(_LISTED)}, date DESC, id::BIGINT) AS position FROM served")
def sort_japanese_genres(spark, d):
    return numbered(_listed(spark, d).select("id", "date", "genre", "pref", "open_date"), pages_of.order_keys("genre"), "position").select("id", "position")


@query(_TABLES + f"SELECT id, ([{_quoted(['#2d5f3f', '#7c6f64', '#4a5c3a', '#6a7f3a', '#3a5a82', '#d97706', '#c95d4a', '#6b7280', '#c4554d', '#143d5c', '#8b1e1e', '#9b2226', '#6b4226'])}])[id::BIGINT * 5 % {len(_LISTED)} + 1] AS colour FROM served")
def card_colours(spark, d):
    return _listed(spark, d).select("id", pages_of.genre_colour(F.col("genre")).alias("colour"))


@query(f"""SELECT o_orderkey, CASE WHEN n > 0 THEN '🎉 ' || md || ' オープン予定（あと' || n || '日）' WHEN n = 0 THEN '🎉 本日 ' || md || ' オープン！' WHEN n >= -7 THEN '🎉 ' || md || ' オープン（' || -n || '日前）' ELSE '🎉 ' || md || ' オープン' END AS label, n >= 0 AS future
FROM (SELECT o_orderkey, date_diff('day', DATE '1998-06-15', o_orderdate::DATE) AS n, strftime(o_orderdate, '%m/%d') AS md FROM orders)""")
def countdown_label(spark, d):
    label = pages_of.countdown(F.to_date("o_orderdate").cast("string"), F.lit("1998-06-15").cast("date"))
    return _read(spark, d, "orders").select("o_orderkey", label["text"].alias("label"), label["future"].alias("future"))


# ---- reports and maintenance


@query(_TABLES + "SELECT id, title, article_url, length(content)::INT AS content_length, content FROM articles ORDER BY published_at DESC, id DESC LIMIT 3")
def topk_latest(spark, d):
    return maintain.inspect_articles(articles(spark, d))


@query(_TABLES + "SELECT id, name, genre, listed_date AS created_at FROM stores WHERE city = 'NATION_3' ORDER BY listed_date DESC, id DESC LIMIT 50")
def topk_city(spark, d):
    return maintain.inspect_city(stores(spark, d).withColumn("created_at", F.col("listed_date")), "NATION_3")


@query(_TABLES + """SELECT count(*) AS n, count(addr) AS n_addr, count(nearest_station) AS n_station, count(tel) AS n_tel, count(*) FILTER (name ILIKE '%9%' OR name ILIKE '%#00000000%') AS n_suspicious,
floor(100 * count(addr) / count(*) + 0.5)::BIGINT AS addr_percent, floor(100 * count(nearest_station) / count(*) + 0.5)::BIGINT AS station_percent, floor(100 * count(tel) / count(*) + 0.5)::BIGINT AS tel_percent FROM stores""")
def audit_coverage(spark, d):
    return maintain.audit(stores(spark, d), ["9", "#00000000"])


@query(_TABLES + "SELECT pref, count(*) AS n FROM stores GROUP BY pref")
def audit_group(spark, d):
    return maintain.count_by(stores(spark, d))


@query(_TABLES + "SELECT 'sources' AS name, count(*) AS n FROM sources UNION ALL SELECT 'articles', count(*) FROM articles UNION ALL SELECT 'stores', count(*) FROM stores UNION ALL SELECT 'store_articles', count(*) FROM links")
def audit_counts(spark, d):
    tables = {"sources": sources, "articles": articles, "stores": stores, "store_articles": links}
    out = None
    for name, make in tables.items():
        row = make(spark, d).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


_PARTS = ["License", "password", "@", "gewinn"]


@query(f"SELECT doc_id FROM documents WHERE {' OR '.join(f'''text ILIKE '%{p}%' ''' for p in _PARTS)}")
def audit_suspicious(spark, d):
    return maintain.suspicious(_read(spark, d, "documents").withColumnRenamed("text", "name"), _PARTS).select("doc_id")


_CLEANED = _TABLES + ", bad AS (SELECT id FROM stores WHERE name ILIKE '%77%' OR name ILIKE '%#00000001%') SELECT 'stores' AS side, id, NULL::BIGINT AS article_id FROM stores WHERE id NOT IN (FROM bad) UNION ALL SELECT 'links', store_id, article_id FROM links WHERE store_id NOT IN (FROM bad)"


@query(_CLEANED)
def cleanup_noise(spark, d):
    kept, joined = maintain.clean_up(stores(spark, d), links(spark, d), ["77", "#00000001"])
    return kept.select(F.lit("stores").alias("side"), "id", F.lit(None).cast("long").alias("article_id")).union(joined.select(F.lit("links"), "store_id", "article_id"))


_PURGED = _TABLES + """, kept AS (SELECT id, duplicate_of_id FROM stores WHERE listed_date >= DATE '2026-01-20' - INTERVAL 2 YEAR), read AS (SELECT id FROM articles WHERE published_at >= DATE '2026-01-20' - INTERVAL 28 YEAR)
SELECT 'stores' AS side, id, CASE WHEN duplicate_of_id NOT IN (SELECT id FROM stores WHERE listed_date < DATE '2026-01-20' - INTERVAL 2 YEAR) THEN duplicate_of_id END AS other FROM kept UNION ALL SELECT 'articles', id, NULL FROM read
UNION ALL SELECT 'links', store_id, article_id FROM links WHERE store_id IN (SELECT id FROM kept) AND article_id IN (SELECT id FROM read)"""


@query(_PURGED)
def purge_retention(spark, d):
    as_of = F.lit("2026-01-20").cast("date")
    shifted = articles(spark, d).withColumn("published_at", F.add_months("published_at", 26 * 12))
    kept, read, joined = changes.purge(stores(spark, d), shifted, links(spark, d), as_of)
    out = kept.select(F.lit("stores").alias("side"), "id", F.col("duplicate_of_id").alias("other"))
    return out.union(read.select(F.lit("articles"), "id", F.lit(None).cast("long"))).union(joined.select(F.lit("links"), "store_id", "article_id"))


_SEEDS = [("https://nation_3.example/", "three", None), ("https://new.example/", "new", "somewhere"), ("https://also.example/", "also", None)]


@query(_TABLES + f""", seeds(url, name, city) AS (VALUES {_values(_SEEDS)}), top AS (SELECT max(id) AS id FROM sources)
SELECT s.id, coalesce(n.name, s.name) AS name, s.url, source_type, enabled, pref, CASE WHEN n.url IS NULL THEN s.city ELSE n.city END AS city FROM sources s LEFT JOIN seeds n USING (url)
UNION ALL SELECT top.id + row_number() OVER (ORDER BY url), name, url, NULL, true, NULL, city FROM seeds, top WHERE url NOT IN (SELECT url FROM sources)""")
def upsert_sources(spark, d):
    rows = spark.createDataFrame(_SEEDS, "url string, name string, city string")
    return changes.upsert(sources(spark, d), rows, ["url"], defaults={"enabled": F.lit(True)})


@query(_TABLES + """, found AS (SELECT p_partkey AS url, CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size % 3 END::BIGINT AS items FROM part WHERE p_size <> 7)
SELECT p_partkey AS url, coalesce(items, -1) AS items, CASE WHEN p_brand = 'Brand#2' THEN 'known' WHEN coalesce(items, -1) > 0 THEN 'fresh' ELSE 'dead' END AS status FROM part LEFT JOIN found ON url = p_partkey""")
def probe_split(spark, d):
    parts = _read(spark, d, "part").withColumnRenamed("p_partkey", "url")
    counts = parts.where("p_size != 7").select("url", F.when(F.col("p_size") % 4 == 0, -1).otherwise(F.col("p_size") % 3).cast("long").alias("items"))
    return maintain.probe_split(parts.select("url"), counts, parts.where("p_brand = 'Brand#2'"))


_PROBED = """, found AS (SELECT p_partkey AS url, CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size % 3 END::BIGINT AS items FROM part WHERE p_size <> 7),
split AS (SELECT p_partkey AS url, p_type AS pref, CASE WHEN p_brand = 'Brand#2' THEN 'known' WHEN coalesce(items, -1) > 0 THEN 'fresh' ELSE 'dead' END AS status FROM part LEFT JOIN found ON url = p_partkey)
"""


def _probed(spark, d):
    parts = _read(spark, d, "part").select(F.col("p_partkey").alias("url"), F.col("p_type").alias("pref"), "p_size", "p_brand")
    counts = parts.where("p_size != 7").select("url", F.when(F.col("p_size") % 4 == 0, -1).otherwise(F.col("p_size") % 3).cast("long").alias("items"))
    return maintain.probe_split(parts.select("url", "pref"), counts, parts.where("p_brand = 'Brand#2'"))


@query(_TABLES + _PROBED + "SELECT s AS status, count(split.status) AS n FROM (VALUES ('fresh'), ('dead'), ('known')) t(s) LEFT JOIN split ON split.status = s GROUP BY s")
def probe_summary(spark, d):
    return maintain.probe_counts(_probed(spark, d))


@query(_TABLES + _PROBED + "SELECT url, pref, row_number() OVER (ORDER BY pref, url) AS position FROM split WHERE status = 'fresh'")
def probe_fresh(spark, d):
    return numbered(_probed(spark, d).where("status = 'fresh'"), maintain.fresh_order(), "position").select("url", "pref", "position")


@query(_TABLES + "SELECT id, name FROM sources WHERE enabled AND (name ILIKE '%nation_1%' OR url ILIKE '%nation_1%')")
def sources_by_keyword(spark, d):
    return maintain.find_sources(sources(spark, d), "nation_1").select("id", "name")


@query(_TABLES + "SELECT id, CASE WHEN city IS NULL THEN CASE WHEN id % 2 = 0 THEN 'name,source_type' ELSE 'name' END ELSE 'source_type' END AS violations FROM sources WHERE city IS NULL OR id % 2 = 0")
def quarantined(spark, d):
    rows = sources(spark, d).select("id", F.col("city").alias("name"), F.when(F.col("id") % 2 == 0, "unknown").otherwise(F.col("source_type")).alias("source_type"))
    return quarantine(rows, "sources")[1].select("id", F.array_join("violations", ",").alias("violations"))


# ---- texts of the driver's tables


@query(f"SELECT doc_id, md5({_sql_normal('text')}) AS text_md5 FROM documents")
def normalize_text(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("text_md5"))


@query(f"SELECT doc_id, md5({_sql_name('text')}) AS name_md5 FROM documents")
def normalize_name_key(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.normalize_name(F.col("text"))).alias("name_md5"))


def _sql_tel(t: str) -> str:
    digits = f"regexp_replace({_sql_normal(t)}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({digits}) >= 9 THEN {digits} END"


def _sql_first(t: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({t}, '{pattern}', {group}), '')"


@query(f"SELECT doc_id, {_sql_tel(_sql_first('text', text._TEL))} AS tel FROM documents")
def normalize_tel(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.extract_tel(F.col("text")).alias("tel"))


_TOPICS = {"licence": ["license", "copyright", "rights"], "money": ["gewinn", "free", "gratis"], "prose": ["the", "and", "ing"], "other": ["der", "les", "que"]}


def _sql_scores(t: str, lists: dict[str, list[str]]) -> str:
    count = lambda w: f"((length({t}) - length(replace({t}, '{w}', ''))) // {len(w)})"
    scores = ", ".join(f"{{'n': {' + '.join(map(count, ws))}, 'o': {-i}, 'label': '{label}'}}" for i, (label, ws) in enumerate(lists.items()))
    best = f"list_reverse_sort([{scores}])[1]"
    return f"CASE WHEN ({best}).n > 0 THEN ({best}).label END"


@query(f"SELECT doc_id, {_sql_scores('text', _TOPICS)} AS topic FROM documents")
def keyword_score_argmax(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.best_label(F.col("text"), _TOPICS).alias("topic"))


@query(f"WITH k AS (SELECT doc_id, {_sql_name('text')} AS key FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS leader FROM k")
def dedupe_exact_key(spark, d):
    keyed = _read(spark, d, "documents").select("doc_id", F.sha2(text.normalize_name(F.col("text")), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("leader")), "key").select("doc_id", "leader")


#: The sequential definition of resolution over r (i from 1, tel, name, area): each step sees the stores made before it.
_FOLD = """f(i, store, made, tels, names) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[], []::VARCHAR[]
  UNION ALL SELECT i, coalesce(hit, len(tels) + 1), hit IS NULL, CASE WHEN hit IS NULL THEN list_append(tels, tel) ELSE tels END, CASE WHEN hit IS NULL THEN list_append(names, name) ELSE names END
  FROM (SELECT r.i, r.tel, r.name, f.tels, f.names, coalesce(CASE WHEN r.tel IS NOT NULL THEN nullif(list_position(f.tels, r.tel), 0) END, nullif(list_position(f.names, r.name), 0))::BIGINT AS hit FROM f JOIN r ON r.i = f.i + 1)),
placed AS (SELECT r.*, f.store AS store_id, f.made FROM f JOIN r USING (i)),
resolved AS (SELECT p.* EXCLUDE (made), CASE WHEN NOT p.made THEN 'merged' WHEN s.first IS NULL THEN 'new' ELSE 'soft' END AS outcome, s.first AS duplicate_of_id FROM placed p
  LEFT JOIN (SELECT p.i, min(o.store_id) AS first FROM placed p JOIN placed o ON p.made AND o.made AND o.i < p.i AND o.area = p.area AND list_contains(string_split(o.name, '-'), left(p.name, 4)) GROUP BY p.i) s USING (i))
"""


@query(f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey AS rank, CASE WHEN c_custkey % 3 <> 0 THEN floor(c_acctbal)::BIGINT::VARCHAR END AS tel, lower(c_mktsegment[1:4]) || '-' || (c_custkey % 997) AS name, c_nationkey AS area FROM customer),
{_FOLD} SELECT rank, outcome, store_id, duplicate_of_id FROM resolved""")
def dedupe_leader(spark, d):
    """Customers resolved in order against each other, by the whole part of their balance and a part of their name."""
    rows = _read(spark, d, "customer").select(F.col("c_custkey").alias("rank"), F.when(F.col("c_custkey") % 3 != 0, F.floor("c_acctbal").cast("long").cast("string")).alias("tel_normalized"), F.concat_ws("-", F.lower(F.substring("c_mktsegment", 1, 4)), (F.col("c_custkey") % 997).cast("string")).alias("name_normalized"), F.col("c_nationkey").cast("string").alias("pref"), F.lit("").alias("city"))
    return resolve.resolve(rows, rows.limit(0).withColumnRenamed("rank", "id")).select("rank", "outcome", "store_id", "duplicate_of_id")


_CHAIN = "SELECT c_custkey AS rank, CASE WHEN c_custkey % 97 <> 0 THEN c_custkey // 2 END AS tel, (c_custkey + 1) // 2 AS name FROM customer"


@query(f"""WITH c AS ({_CHAIN}), l AS (SELECT rank, coalesce(tel = lag(tel) OVER w OR name = lag(name) OVER w, false) AS linked FROM c WINDOW w AS (ORDER BY rank)),
s AS (SELECT rank, count(*) FILTER (NOT linked) OVER (ORDER BY rank) AS part FROM l) SELECT rank, row_number() OVER (PARTITION BY part ORDER BY rank) % 2 = 1 AS leads FROM s""")
def chain_leaders(spark, d):
    """Customers in chains, each sharing a key with the next: every other one of a chain leads."""
    rows = _read(spark, d, "customer").selectExpr("c_custkey AS rank", "CASE WHEN c_custkey % 97 <> 0 THEN c_custkey div 2 END AS tel", "(c_custkey + 1) div 2 AS name")
    return resolve.leaders(rows, fold_rows=100).select("rank", "leads")


_GRAMS = "list_distinct(list_transform(range(1, length(name) + 2), lambda i: ('  ' || name || ' ')[i:i + 2]))"


@query(f"""WITH n AS (SELECT DISTINCT p_brand AS pref, p_type AS city, p_name || ' ' || p_size AS name FROM part), g AS (SELECT *, {_GRAMS} AS grams FROM n),
p AS (SELECT a.pref, a.city, a.name AS left_name, b.name AS right_name, len(list_intersect(a.grams, b.grams)) AS common, len(a.grams) + len(b.grams) AS held FROM g a JOIN g b ON a.pref = b.pref AND a.city = b.city)
SELECT pref, city, left_name, right_name, round(common / (held - common), 6) AS similarity FROM p WHERE common >= 0.6::DOUBLE * (held - common)""")
def similar_part_names(spark, d):
    """Parts of a brand and type whose names are alike by six tenths of their trigrams."""
    rows = _read(spark, d, "part").select(F.col("p_brand").alias("pref"), F.col("p_type").alias("city"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    return similar.similar_names(rows, rows, threshold=0.6).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT doc_id, {_sql_scores('text', _TOPICS)} AS topic FROM documents")
def topics_by_table(spark, d):
    """As keyword_score_argmax, with the words in a table that is joined."""
    listed = spark.createDataFrame([(label, w, i) for i, (label, ws) in enumerate(_TOPICS.items()) for w in ws], "label string, word string, order int")
    return dictionary.best_label(_read(spark, d, "documents"), listed, key="doc_id").select("doc_id", F.col("label").alias("topic"))


@query(_TABLES + "SELECT id, ((n - 1) // 40 + 1)::BIGINT AS page FROM (SELECT id, row_number() OVER (ORDER BY open_date DESC NULLS LAST, listed_date DESC, id) AS n FROM stores) WHERE n <= 160")
def pages_by_key(spark, d):
    """The first four pages of stores by opening day, each asked for by the last row of the one before."""
    folder, keys = shared_folder(spark), [pages.Key("open_date", True), pages.Key("listed_date", True), pages.Key("id")]
    pages.lay_out(stores(spark, d).select("id", "name", "open_date", "listed_date"), keys, folder, files=12)
    out, last = None, None
    for number in range(1, 5):
        found = pages.page(spark, folder, keys, 40, last)
        rows = found.collect()  # a page
        last = rows[-1].asDict() if rows else last
        shown = found.select("id", F.lit(number).cast("long").alias("page"))
        out = shown if out is None else out.union(shown)
    return out


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-20' THEN 2 ELSE 1 END::BIGINT AS n FROM events")
def recent_events_once(spark, d):
    """Events that come again: at once, where a stream knows them still, and forty days later, where it has forgotten them."""
    folder, seen = shared_folder(spark), _read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    again = seen.where("event_id % 10 = 0 AND ts < '2024-01-20'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
    for part in (seen, seen.where("event_id % 3 = 0"), again):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    once = poll.recent_once(stream, "event_id", "ts", "2 days")
    once.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{folder}/out").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def count_by_language(spark, d):
    return maintain.count_by(_read(spark, d, "documents"), "lang")


_SQL_TAGLESS = r"regexp_replace(coalesce({0}, ''), '<!--.*?-->|<!?/?[A-Za-z][^>]*>', '', 'gs')"


def _sql_strip(t: str) -> str:
    out = _SQL_TAGLESS.format(t)
    for entity, char in html._ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')" if entity != "&#39;" else f"replace({out}, '{entity}', '''')"
    return _sql_squeeze(out)


@query(f"SELECT page_id, md5({_sql_strip('html')}) AS text_md5 FROM pages")
def strip_html(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(html.strip_html(F.col("html"))).alias("text_md5"))


_IMAGES = [(1, "<p><img alt='x' data-src=no src='a.png'><img src=b>"), (2, "<p>none"), (3, None), (4, '<IMG SRC="https://x/y.jpg">'), (5, "<img src=c.gif alt=1>"), (6, "<img alt=2>")]


@query(f"""SELECT id, coalesce(nullif(regexp_extract(a, '(?is)(?:^|[\\s"''])src\\s*=\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(a, '(?is)(?:^|[\\s"''])src\\s*=\\s*''([^'']*)''', 1), ''), nullif(regexp_extract(a, '(?is)(?:^|[\\s"''])src\\s*=\\s*([^\\s"''>]+)', 1), '')) AS image
FROM (SELECT page_id AS id, nullif(regexp_extract(replace(p.html, '<article>', '<article>' || t.html), '(?is)<img\\b([^>]*)>', 1), '') AS a FROM pages p JOIN (VALUES {_values(_IMAGES)}) t(n, html) ON n = page_id % 6 + 1)""")
def first_image(spark, d):
    """The pages, each with one of six ways to write an image, or none, in its article."""
    image = F.element_at(F.array(*[F.lit(h) for _, h in _IMAGES]), (F.col("page_id") % 6 + 1).cast("int"))
    shown = F.when(image.isNotNull(), F.replace(F.col("html"), F.lit("<article>"), F.concat(F.lit("<article>"), image)))
    return _read(spark, d, "pages").select(F.col("page_id").alias("id"), html.first_image(shown).alias("image"))


_BODY = "regexp_extract(html, '(?s)<body>(.*?)(?:</body>|\\z)', 1)"
for _tag in ("script", "style", "nav", "footer"):
    _BODY = f"regexp_replace({_BODY}, '(?s)<{_tag}>.*?(?:</{_tag}>|\\z)', '', 'g')"
_ENTITY = lambda t: f"replace(replace({t}, '&middot;', '·'), '&copy;', '©')"


@query(f"""WITH p AS (SELECT page_id, {_sql_strip(_ENTITY("regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\\z)', 1)"))} AS article, {_SQL_TAGLESS.format("regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\\z)', 1)")} AS loose, {_sql_strip(_ENTITY(_BODY))} AS body FROM pages)
SELECT page_id, md5(left(CASE WHEN length(trim(loose)) > 200 THEN article ELSE body END, 10000)) AS text_md5, NULL::VARCHAR AS thumbnail FROM p""")
def main_content(spark, d):
    main = html.main_content(F.col("html"))
    return _read(spark, d, "pages").select("page_id", main.alias("main")).select("page_id", F.md5("main.text").alias("text_md5"), "main.thumbnail")


@query(f"""SELECT page_id, CASE WHEN length(page) > length(coalesce(text, '')) THEN 'page' ELSE 'feed' END AS chosen, md5(substr(CASE WHEN length(page) > length(coalesce(text, '')) THEN page ELSE coalesce(text, '') END, 1, 5000)) AS content_md5
FROM (SELECT page_id, substr({_sql_strip('html')}, 1, 10000) AS page, text FROM pages LEFT JOIN documents ON doc_id = page_id)""")
def content_choice(spark, d):
    rows = _read(spark, d, "pages").select("page_id", F.substring(html.strip_html(F.col("html")), 1, 10_000).alias("page")).join(_read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("text", F.lit("")).alias("feed")), "page_id", "left").fillna("", ["feed"])
    longer = text.utf16_length(F.col("page")) > text.utf16_length(F.col("feed"))
    return rows.select("page_id", F.when(longer, "page").otherwise("feed").alias("chosen"), F.md5(F.substring(F.when(longer, F.col("page")).otherwise(F.col("feed")), 1, ingest.CONTENT)).alias("content_md5"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def known_url_skip(spark, d):
    """Documents as items, of which those with a label are known."""
    items = _read(spark, d, "documents").select("doc_id", "lang")
    return ingest.skip_known(items, "doc_id", _read(spark, d, "labels"), "doc_id")


# ---- feeds and polls


def _feeds_of(rows: DataFrame, key: str, item: Column) -> DataFrame:
    """One feed a source (source_id, xml) of items in order of ``key``."""
    one = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    return one.select("source_id", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml"))


def _page_feeds(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "pages").withColumn("source_id", F.col("page_id") % 10 + F.expr("page_id div 1000") * 10)
    return _feeds_of(rows, "page_id", F.format_string("<item><title>T&amp;%d</title><link>%s#a=1&b=2</link></item>", "page_id", "url"))


@query("SELECT page_id % 10 + page_id // 1000 * 10 AS source_id, count(*) AS items FROM pages GROUP BY ALL UNION ALL VALUES (-1, -1), (-2, 0)")
def feed_item_counts(spark, d):
    """Items of each feed, of one that is no XML and of one without items."""
    more = spark.createDataFrame([(-1, "<rss>"), (-2, "<rss><channel></channel></rss>")], "source_id long, xml string")
    return feeds.item_counts(_page_feeds(spark, d).union(more), "source_id")


@query("SELECT page_id % 10 AS source_id, page_id // 10 AS ordinal, 'T&' || page_id AS title, url || '#a=1&b=2' AS link, false AS broken FROM pages UNION ALL SELECT -1, NULL, NULL, NULL, true")
def feed_items(spark, d):
    """The pages' addresses written as feeds whose ampersands are bare, and read again; one feed is no XML.

    A source's pages are written in parts of up to 100, so that no feed grows with the table.
    """
    out = feeds.feed_items(_page_feeds(spark, d).union(spark.createDataFrame([(-1, "<rss>")], "source_id long, xml string")))
    return out.select((F.col("source_id") % 10).alias("source_id"), (F.col("ordinal") + F.expr("source_id div 10") * 100).cast("long").alias("ordinal"), "title", "link", "broken")


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN '号外NET ' || n_name ELSE n_name || '経済新聞' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'https://' || lower(n_name) || '.goguynet.jp/' ELSE 'https://' || lower(n_name) || '.keizai.biz/' END AS url,
CASE WHEN n_nationkey % 2 = 0 THEN 'https://' || lower(n_name) || '.goguynet.jp/category/cat_openclose/feed/' ELSE 'https://' || lower(n_name) || '.keizai.biz/rss.xml' END AS rss_url, CASE WHEN n_nationkey % 2 = 0 THEN '号外NET' ELSE '経済新聞' END AS source_type, '東京都' AS pref, n_name AS city FROM nation""")
def source_templates(spark, d):
    return feeds.templated_sources(_read(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "号外NET").otherwise("経済新聞").alias("source_type"), F.lower("n_name").alias("sub"), F.col("n_name").alias("label"), F.lit("東京都").alias("pref"), F.col("n_name").alias("city")))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def append_once(spark, d):
    """Events taken in by a stream, and by another one that starts over: the second adds nothing."""
    schema = _read(spark, d, "events").schema
    folder = shared_folder(spark)
    for run in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
        poll.append_new(stream, "event_id", "ts", f"{folder}/table", f"{folder}/{uuid.uuid4().hex}", first_batch=1000 * run).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("event_id", "user_id", "event_type")


# ---- Japanese texts, as literal rows

_TEXTS = [
    (1, "【開店】メニューいろいろ！立川駅南口の『ラーメン赤豚』で「旨辛つけ麺」食べてみた", "住所は東京都北区赤羽１−２２−８ ミヤビル 電話：03-1234-5678", "東京都"),
    (2, "千葉駅から徒歩10分に7/3オープン、KARUKARIで頂くポークビンダルーカレー", "場所は渋谷区道玄坂2-10-7です ☎0466-12-3456", "東京都"),
    (3, "2026年4月25日オープン 麺屋さくら", "渋谷区道玄坂二丁目 0123-456 電話 03-1234-5678", "東京都"),
    (4, "麺屋さくらが4月25日オープン予定！", "東京都北区赤羽1-22-8（※公開時点の情報）", "東京都"),
    (5, "「新店」麺屋さくら オープン", "埼玉県さいたま市大宮区桜木町2-1-1 03-1111", "埼玉県"),
    (6, "オープン", "東京都東村山市本町1", "東京都"),
    (7, "葛飾に「喫茶ひなた」", "4月に開店した喫茶店", "東京都"),
    (8, "葛飾に「喫茶ひなた」", "喫茶店", "東京都"),
    (9, "ラーメン一番が閉店、店主の故郷へ移転", "", "千葉県"),
    (10, "ラーメン一番が閉店、隣駅へ移転オープン", None, "千葉県"),
    (11, "美容室が開店、隣はカフェ", "千葉県柏市柏1-1-11 開店日 2026/5/1", "千葉県"),
    (12, "令和8年度越谷市省エネ家電買換促進補助金 受付終了のお知らせ", "オープン日：2026/5/1", "埼玉県"),
    (13, "中華食堂 ちゃんぽん亭 越谷店 開店", "2019年4月25日オープン", "埼玉県"),
    (14, "餃子酒場 GYOZA HOUSE 新規オープン", "2026年13月45日オープン 餃子専門店の餃子", "埼玉県"),
    (15, "丸亀製麺 駅前店 グランドオープン！", "カクテルと居酒屋 東京都千葉駅から", "愛知県"),
    (16, "コ-メダ珈琲 OPEN", "とてもおいしいお店は千葉中央駅", "大阪府"),
    (17, "MEGUMI食堂がオープン", "大学病院駅、柏駅、新宿三丁目駅", "京都府"),
    (18, None, "ダイニングバーとバル", None),
    (19, "", "", ""),
    (20, "１２．「焼肉 にくまる」　リニューアルオープン", "神奈川県横浜市西区南幸1-6-31 045-321-1111 5月3日に開業", "神奈川県"),
]
#: Each document with one of the texts: its title, and its content before the document's own.
_ROWS = f"""WITH l(n, title, content, pref) AS (VALUES {_values(_TEXTS)}),
r AS (SELECT doc_id AS id, title, content || ' ' || coalesce(text, '') AS content, pref FROM documents JOIN l ON n = doc_id % {len(_TEXTS)} + 1)"""


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TEXTS, "id int, title string, content string, pref string")


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    one = F.element_at(F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("title", "content", "pref"), row[1:])]) for row in _TEXTS]), (F.col("doc_id") % len(_TEXTS) + 1).cast("int"))
    rows = _read(spark, d, "documents").select("doc_id", "text", one.alias("of"))
    return rows.select(F.col("doc_id").alias("id"), "of.title", F.concat("of.content", F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"), "of.pref")


_TEXT_SQL: dict[str, str] = {}


def _on_texts(name: str, sql: str, column: Callable[[], Column]) -> None:
    _TEXT_SQL[name] = sql

    @query(f"{_ROWS} SELECT id, {sql} AS value FROM r", name)
    def run(spark, d):
        return _long_texts(spark, d).select("id", column().alias("value"))


_T, _C, _BOTH = "coalesce(title, '')", "coalesce(content, '')", "concat_ws(' ', title, content)"
_content, _title = (lambda: F.col("content")), (lambda: F.col("title"))
_both = lambda: F.concat_ws(" ", "title", "content")
_SHOPS = "専門店|食堂|レストラン|ダイニング|カフェ|酒場|バル|ビストロ|店"

_on_texts("extract_pref", "CASE " + " ".join(f"WHEN contains(content, '{p}') THEN '{p}'" for p in words.PREFS) + " END", lambda: text.extract_pref(_content()))
_on_texts("extract_city", "CASE pref " + " ".join(f"WHEN '{p}' THEN {_sql_first('content', f'{p}([^0-9\\-{_WHITE}]+?[市区町村])')}" for p in words.PREFS) + " END", lambda: text.extract_city(_content(), F.col("pref")))
_on_texts("extract_tel", _sql_tel(_sql_first("content", text._TEL)), lambda: text.extract_tel(_content()))
_on_texts("extract_station", f"list_filter(regexp_extract_all({_BOTH}, '(?:^|[^{text._RUN}])([{text._RUN}]{{2,6}}駅)', 1), lambda s: NOT regexp_matches(s, '(?:病院駅|郵便駅)$'))[1]", lambda: text.extract_station(_both()))
_on_texts("is_opening_article", _sql_any(_BOTH, ["オープン", "OPEN", "開店", "開業", "新規オープン", "新店"]), lambda: text.is_opening_article(_title(), _content()))
_on_texts("is_chain_store", _sql_any(f"translate(title, '{text._DASHES}', '')", [w.translate(str.maketrans("", "", text._DASHES)) for w in words.CHAINS]), lambda: text.is_chain(_title()))
_on_texts(
    "is_food_opening",
    f"""({_sql_any(_T, words.TITLE_OPENINGS)} OR (regexp_matches({_T}, '[にへ]「[^」]{{2,}}」|[にへ][^{_WHITE}、。]{{0,14}}(?:{_SHOPS})(?:が|、|を|[{_WHITE}]|$)') AND {_sql_any(_C, ["オープン", "開店", "開業"])}))
    AND NOT {_sql_any(_T, words.TITLE_REJECTS)} AND NOT ({_sql_any(_T, ["閉店", "閉業", "ラストデー", "ラストオーダー終了"])} AND NOT regexp_matches({_T}, '(?i)オープン|OPEN|開店|開業'))
    AND NOT {_sql_any(f"({_T} || ' ' || {_C})", words.NON_FOOD)} AND {_sql_any(f"({_T} || ' ' || {_C})", words.FOOD)}""",
    lambda: text.is_food_opening(_title(), _content()),
)
_on_texts("extract_genre", f"coalesce(CASE {' '.join(f'WHEN {_sql_any(_T, ws)} THEN {chr(39)}{g}{chr(39)}' for g, ws in words.GENRES.items())} END, {_sql_scores('content', words.GENRES)})", lambda: text.extract_genre(_content(), _title()))


def _sql_date() -> str:
    opens, full = text._OPENS, text._FULL_DATE

    def dated(pattern: str) -> str:
        y, m, d = (f"try_cast({_sql_first(_BOTH, pattern, i)} AS INT)" for i in (1, 2, 3))
        return f"CASE WHEN {y} BETWEEN 2025 AND 2028 THEN {y} || '-' || lpad({m}::VARCHAR, 2, '0') || '-' || lpad({d}::VARCHAR, 2, '0') END"

    m, d = (f"try_cast({_sql_first(_BOTH, f'(\\d{{1,2}})月(\\d{{1,2}})日[{_WHITE}]*(?:に?[{_WHITE}]*{opens})', i)} AS INT)" for i in (1, 2))
    return f"coalesce({dated(f'{full}日?(?:に?[{_WHITE}]*{opens})')}, {dated(f'(?:オープン日?[:：]?[{_WHITE}]*|OPEN[:：]?[{_WHITE}]*){full}')}, '2026-' || lpad({m}::VARCHAR, 2, '0') || '-' || lpad({d}::VARCHAR, 2, '0'))"


_on_texts("extract_date", _sql_date(), lambda: text.extract_open_date(_both(), F.lit(2026)))


def _sql_address() -> str:
    plain = f"regexp_replace({_sql_normal('content')}, '{text._LABEL}', '', 'g')"
    before = f"(?:^|[^{text._RUN}])"
    city = text._CITY_ADDRESS.replace(f"(?<![{text._RUN}])", before)
    block = text._CHOME_ADDRESS.replace(f"(?<![{text._RUN}])", before)
    found = f"coalesce({_sql_first(plain, text._FULL_ADDRESS)}, nullif(pref, '') || {_sql_first(plain, city)}, nullif(pref, '') || {_sql_first(plain, block)})"
    bare = f"regexp_replace({_sql_normal('found')}, '\\s*[※（(【](.|\\n)*$', '')"
    return f"(SELECT CASE WHEN found IS NOT NULL THEN trim(regexp_replace({bare}, '[、。\\s]+$', '')) END FROM (SELECT {found} AS found))"


_on_texts("extract_address", _sql_address(), lambda: text.extract_address(_content(), F.col("pref")))


def _sql_store_name() -> str:
    opens = "(?:オープン|OPEN|開店|開業|グランドオープン)"
    start = f"trim(regexp_replace(trim(regexp_replace(regexp_replace({_sql_normal('title')}, '【[^】]*】\\s*', '', 'g'), '^\\s*\\d+[.、]\\s*', '')), '(?i)^(?:\\d{{4}}年)?\\d{{1,2}}月\\d{{1,2}}日\\s*(?:に|の)?\\s*(?:オープン|OPEN|開店|開業|グランドオープン|新規オープン)(?:予定)?[、,\\s]*', ''))"
    end = "[！!？?。]*\\s*$"
    news = [f"[、。]?\\s*{day}\\s*{opens}(?:予定)?{end}" for day in ("\\d{1,4}年\\d{1,2}月\\d{1,2}日", "\\d{1,2}月\\d{1,2}日", "\\d{1,2}月")] + [f"[、。]?\\s*(?:に|で|へ|が|は|を)?\\s*(?:新規)?{opens}(?:予定|へ)?{end}"]
    rest = "t"
    for pattern in news * 4:
        rest = f"trim(regexp_replace({rest}, '{pattern}', ''))"
    rest = f"trim(regexp_replace({rest}, '[、。]?\\s*(?:注目|話題|大人気)\\s*$', ''))"
    good = lambda x: f"CASE WHEN length({x}) >= 2 AND {x} NOT IN ({_quoted(words.NAME_REJECTS)}) THEN {x} END"
    return f"""(SELECT coalesce({good('quoted')}, {good('reviewed')}, CASE WHEN rest <> '' AND rest NOT IN ({_quoted(words.NAME_REJECTS)}) THEN rest END) FROM (SELECT
      trim(regexp_replace(regexp_extract(t, '「([^」]+)」|『([^』]+)』', 0), '^.|.$', '', 'g')) AS quoted,
      trim(regexp_extract(t, '(?:オープン|OPEN|開店|開業)[、,\\s]+([^、。]{{2,30}}?)(?:で(?:頂く|いただく|味わう|食べ|楽し|堪能|楽しむ)|にて)', 1)) AS reviewed, {rest} AS rest FROM (SELECT {start} AS t)))"""


_on_texts("extract_store_name", _sql_store_name(), lambda: text.extract_store_name(_title()))
_on_texts("normalize_address", f"translate(regexp_replace({_sql_normal('content')}, '[{_WHITE}]+', '', 'g'), '‐－−ー―', '-----')", lambda: text.normalize_address(_content()))


#: The text functions as SQL calls them: each as registered, with its arguments.
_CALLS = {
    "extract_pref": "extract_pref(content)", "extract_city": "extract_city(content, pref)", "extract_tel": "extract_tel(content)", "extract_station": "extract_station(concat(title, ' ', content))",
    "is_opening_article": "is_opening_article(title, content)", "is_chain_store": "is_chain_store(title)", "extract_genre": "extract_genre(content, title)", "extract_address": "extract_address(content, pref)",
    "extract_store_name": "extract_store_name(title)", "normalize_address": "normalize_address(content)",
}


@query(f"{_ROWS} SELECT id, {', '.join(f'{_TEXT_SQL[k]} AS {k}' for k in _CALLS)} FROM r")
def sql_functions(spark, d):
    """The text functions called from SQL, over every document's text."""
    sql.register(spark)
    _long_texts(spark, d).createOrReplaceTempView("kawara_texts")
    return spark.sql(f"SELECT id, {', '.join(f'{call} AS {k}' for k, call in _CALLS.items())} FROM kawara_texts")


@query(_TABLES + """, one AS (SELECT store_id AS id, min(article_id) AS article_id FROM links GROUP BY store_id)
SELECT s.id, CASE WHEN a.title LIKE '%HIGH%' THEN 'urgent' ELSE s.genre END AS genre FROM stores s LEFT JOIN one USING (id) LEFT JOIN articles a ON a.id = one.article_id""")
def update_genres(spark, d):
    """Stores whose first article is urgent take that as their genre; the others keep theirs."""
    one = links(spark, d).groupBy(F.col("store_id").alias("id")).agg(F.min("article_id").alias("article_id"))
    read = one.join(articles(spark, d).where("title LIKE '%HIGH%'").select(F.col("id").alias("article_id")), "article_id")
    return changes.update(stores(spark, d), read.select("id", F.lit("urgent").alias("genre"))).select("id", "genre")


_NEWS = [("ラーメンの話", "寿司と鮨"), ("news", "寿司と鮨とカフェ"), ("news", "なし"), ("news", "うどん")]


_RECLASSIFIED = _TABLES + """, one AS (SELECT store_id AS id, min(article_id) AS article_id FROM links GROUP BY store_id)
SELECT s.id, coalesce(CASE article_id % 4 WHEN 0 THEN 'ラーメン' WHEN 1 THEN '寿司' WHEN 3 THEN 'うどん' END, CASE WHEN s.id % 5 = 0 THEN 'ラーメン' ELSE s.genre END) AS genre FROM stores s LEFT JOIN one USING (id)"""


@query(_RECLASSIFIED)
def reclassify_genres(spark, d):
    """Stores whose first article tells another genre than theirs."""
    news = F.element_at(F.array(*[F.struct(F.lit(t).alias("title"), F.lit(c).alias("content")) for t, c in _NEWS]), (F.col("id") % 4 + 1).cast("int"))
    read = articles(spark, d).select("id", news.alias("n")).select("id", "n.*")
    known = stores(spark, d).withColumn("genre", F.when(F.col("id") % 5 == 0, "ラーメン").otherwise(F.col("genre"))).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return maintain.reclassify(known, links(spark, d), read, F.lit(TODAY).cast("timestamp")).select("id", "genre")


# ---- changes that reach the tables, and what is read back


def _stored(spark: SparkSession, d: str, articles_too: DataFrame | None = None, batches: int = 4) -> Tables:
    """The catalogue's tables in a new folder, their rows dealt to batches by store."""
    tables = Tables(spark, f"{shared_folder(spark)}/tables").create()
    read = articles_too if articles_too is not None else articles(spark, d)
    rows = {"stores": stores(spark, d).withColumn("batch", F.col("id") % batches), "store_articles": links(spark, d).withColumn("batch", F.col("store_id") % batches), "articles": read.withColumn("batch", F.col("id") % batches)}
    for table, df in rows.items():
        tables.append_batches(table, df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in tables.read(table).schema.fields if f.name not in df.columns]))
    return tables


@query(_PURGED)
def purge_tables(spark, d):
    tables = _stored(spark, d, articles(spark, d).withColumn("published_at", F.add_months("published_at", 26 * 12)))
    tables.purge(F.lit("2026-01-20").cast("date"))
    out = tables.read("stores").select(F.lit("stores").alias("side"), "id", F.col("duplicate_of_id").alias("other"))
    return out.union(tables.read("articles").select(F.lit("articles"), "id", F.lit(None).cast("long"))).union(tables.read("store_articles").select(F.lit("links"), "store_id", "article_id"))


@query(_CLEANED)
def cleanup_tables(spark, d):
    tables = _stored(spark, d)
    maintain.clean_up_in(tables, ["77", "#00000001"])
    return tables.read("stores").select(F.lit("stores").alias("side"), "id", F.lit(None).cast("long").alias("article_id")).union(tables.read("store_articles").select(F.lit("links"), "store_id", "article_id"))


@query(_RECLASSIFIED)
def reclassify_tables(spark, d):
    news = F.element_at(F.array(*[F.struct(F.lit(t).alias("title"), F.lit(c).alias("content")) for t, c in _NEWS]), (F.col("id") % 4 + 1).cast("int"))
    tables = _stored(spark, d, articles(spark, d).drop("title", "content").withColumn("n", news).select("*", "n.*").drop("n"))
    tables.update("stores", tables.read("stores").where("id % 5 = 0").select("id", F.lit("ラーメン").alias("genre")))
    maintain.reclassify_in(tables, F.lit(TODAY).cast("timestamp"))
    return tables.read("stores").select("id", "genre")


@query("SELECT 'articles' AS name, 0::BIGINT AS n, (SELECT max(o_orderkey) FROM orders) AS top UNION ALL SELECT 'stores', 0, (SELECT max(c_custkey) FROM customer) UNION ALL SELECT 'known', 0, NULL")
def reset_tables(spark, d):
    """The tables after a reset: no rows, no known URLs, and the largest ids that were given, as they were."""
    tables = _stored(spark, d)
    maintain.reset_in(tables)
    out = [tables.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).withColumn("top", F.lit(tables.top(t)).cast("long")) for t in ("articles", "stores")]
    return out[0].union(out[1]).union(tables.known(articles(spark, d).select("article_url")).agg(F.lit("known"), F.count("*"), F.lit(None).cast("long")))


@query("SELECT o_orderkey AS id, 'https://news.example/' || o_orderkey AS known FROM orders UNION ALL SELECT -1, NULL FROM range(2)")
def compacted_tables(spark, d):
    """Articles of forty batches, made few: their rows, whether each URL is still known, and a row for each batch left."""
    tables = _stored(spark, d, batches=40)
    tables.compact(40)
    rows = tables.read("articles").select("id", "article_url")
    known = tables.known(rows.select("article_url"))
    left = tables.at["articles"].read().select("batch").distinct()
    left = left.union(tables.at["article_keys"].read().select("batch").distinct())
    return rows.join(known.withColumn("known", F.col("article_url")), "article_url", "left").select("id", "known").union(left.select(F.lit(-1).cast("long"), F.lit(None).cast("string")))


@query("SELECT 'stores' AS name, 0::BIGINT AS n")
def truncate_stores(spark, d):
    return changes.truncate(stores(spark, d)).agg(F.lit("stores").alias("name"), F.count("*").alias("n"))


#: Customers as news: no food (0), a chain (1), a source without a city (2), else a shop with a name and maybe a phone,
#: which others share. A source has up to 100 of them.
_NEWS_ROWS = """k AS (SELECT c_custkey AS key, c_custkey % 11 AS kind, c_custkey // 100 * 3 + CASE WHEN c_custkey % 11 = 2 THEN 2 ELSE c_custkey % 2 END AS source_id, c_custkey // 100 % 2 AS batch,
  CASE WHEN c_custkey % 5 <> 0 THEN '03' || lpad((c_custkey % 389)::VARCHAR, 4, '0') || '5678' END AS tel, '麺屋' || lpad((c_custkey % 83)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE (c_custkey % 7) || '号' END AS name FROM customer)"""


def _sql_news(order: str) -> str:
    return f"""WITH RECURSIVE {_NEWS_ROWS}, a AS (SELECT *, row_number() OVER (ORDER BY {order}) AS article_id FROM k WHERE kind <> 0),
r AS (SELECT row_number() OVER (ORDER BY article_id) AS i, article_id, tel, name, 0 AS area FROM a WHERE kind > 2), {_FOLD}
SELECT 'article' AS side, article_id AS id, 'https://news.example/' || key AS other FROM a
UNION ALL SELECT 'store', store_id, name || ' ' || coalesce(tel, '-') || ' ' || coalesce(duplicate_of_id::VARCHAR, '-') FROM resolved WHERE outcome <> 'merged'
UNION ALL SELECT 'link', store_id, article_id::VARCHAR FROM resolved"""


_NEWS_COUNTS = " UNION ALL SELECT 'count', n, status FROM (SELECT CASE kind WHEN 1 THEN 'chain' ELSE 'incomplete' END AS status, count(*) AS n FROM a WHERE kind < 3 GROUP BY ALL UNION ALL SELECT CASE outcome WHEN 'merged' THEN 'merged' ELSE 'added' END, count(*) FROM resolved GROUP BY ALL)"


def _news(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Feeds (source_id, xml, fetched_at) and their sources."""
    key = F.col("c_custkey")
    kind, padded = key % 11, lambda n, w: F.lpad((key % n).cast("string"), w, "0")
    name = F.concat(F.lit("麺屋"), padded(83, 2), F.when(key % 13 == 0, "").otherwise(F.concat((key % 7).cast("string"), F.lit("号"))))
    title = F.when(kind == 0, "美容室オープン").when(kind == 1, F.concat(F.lit("カフェ「スターバックス"), name, F.lit("」オープン"))).otherwise(F.concat(F.lit("ラーメン「"), name, F.lit("」オープン")))
    body = F.when(key % 5 != 0, F.concat(F.lit("電話 03-"), padded(389, 4), F.lit("-5678"))).otherwise("とんこつ")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://news.example/"), key.cast("string"), F.lit("</link><description>"), body, F.lit("</description></item>"))
    rows = _read(spark, d, "customer").select(key, (F.expr("c_custkey div 100") * 3 + F.when(kind == 2, 2).otherwise(key % 2)).cast("long").alias("source_id"), item.alias("item"))
    written = _feeds_of(rows, "c_custkey", F.col("item")).withColumn("fetched_at", F.lit("2026-04-23").cast("timestamp"))
    known = rows.select(F.col("source_id").alias("id")).distinct().select("id", F.lit("東京都").alias("pref"), F.when(F.col("id") % 3 != 2, "北区").alias("city"), F.lit(True).alias("enabled"))
    return written, known


def _told(new_articles: DataFrame, new_stores: DataFrame, joined: DataFrame) -> DataFrame:
    out = new_articles.select(F.lit("article").alias("side"), "id", F.col("article_url").alias("other"))
    out = out.union(new_stores.select(F.lit("store"), "id", F.concat_ws(" ", "name_normalized", F.coalesce("tel_normalized", F.lit("-")), F.coalesce(F.col("duplicate_of_id").cast("string"), F.lit("-")))))
    return out.union(joined.select(F.lit("link"), "store_id", F.col("article_id").cast("string")))


@query(_sql_news("source_id, key") + _NEWS_COUNTS)
def ingest_run(spark, d):
    """One batch of news taken into empty tables: articles, stores, links, and the run's counts."""
    written, known = _news(spark, d)
    nothing = lambda t: spark.createDataFrame([], SCHEMAS[t])
    out = ingest.ingest(written, _read(spark, d, "pages").select("url", "html"), known, nothing("articles"), nothing("stores"), F.lit("2026-04-23").cast("timestamp"))
    return _told(out.articles, out.stores, out.links).union(out.counts.select(F.lit("count"), "n", "status"))


def _polled(spark: SparkSession, d: str, view: bool = False) -> Tables:
    written, known = _news(spark, d)
    folder = shared_folder(spark)
    tables = Tables(spark, f"{folder}/tables").create()
    tables.append("sources", known.select("*", *[F.col("id").cast("string").alias(c) for c in ("name", "url")], *[F.lit(None).cast("string").alias(c) for c in ("rss_url", "source_type")], *[F.lit(None).cast("timestamp").alias(c) for c in ("last_crawled_at", "created_at")]), -1)
    pages = _read(spark, d, "pages").select("url", "html")
    if view:
        served_view.rebuild(tables)
    first = F.expr("source_id div 3") % 2 == 0
    for part in (written.where(first), written.where(~first), written.where(first).limit(3)):
        part.write.mode("append").parquet(f"{folder}/feeds")
        poll.poll(spark, f"{folder}/feeds", pages, tables, f"{folder}/progress", view=view).awaitTermination()
    return tables


@query(_sql_news("batch, source_id, key"))
def poll_twice(spark, d):
    """The news landing in two parts, polled after each and once more: what is known isn't taken in again."""
    tables = _polled(spark, d)
    return _told(tables.read("articles"), tables.read("stores"), tables.read("store_articles"))


@query(_sql_news("batch, source_id, key").split("SELECT 'article' AS side")[0] + """SELECT store_id AS id, arg_max('ラーメン「' || resolved.name || '」オープン', resolved.article_id) AS article_title,
string_agg('https://news.example/' || key, ' ' ORDER BY resolved.article_id DESC) AS urls FROM resolved JOIN a USING (article_id) GROUP BY store_id""")
def served_after_polls(spark, d):
    """The stored view after polls, each of which merged its batch into it: stores with their latest title and articles."""
    rows = served_view.view(_polled(spark, d, view=True))
    return rows.select("id", "article_title", F.array_join(F.transform("sources", lambda s: s["url"]), " ").alias("urls"))


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\\z)', 1)"


@query(f"""WITH k AS (SELECT page_id, page_id // 100 AS source_id, url || CASE WHEN page_id % 5 = 0 THEN '#none' ELSE '' END AS link FROM pages WHERE page_id % 7 <> 0),
a AS (SELECT *, row_number() OVER (ORDER BY source_id, page_id) AS id FROM k QUALIFY row_number() OVER (PARTITION BY link ORDER BY source_id, page_id) = 1),
h AS (SELECT url AS link, max(html) AS html FROM pages GROUP BY url),
p AS (SELECT link, {_sql_strip(_ENTITY(_ARTICLE))} AS article, {_SQL_TAGLESS.format(_ARTICLE)} AS loose, {_sql_strip(_ENTITY(_BODY))} AS body FROM h),
m AS (SELECT a.*, coalesce(left(CASE WHEN length(trim(loose)) > 200 THEN article ELSE body END, 10000), '') AS page FROM a LEFT JOIN p USING (link))
SELECT 'article' AS side, id, link || ' ' || md5(left(CASE WHEN length(page) > 4 THEN page ELSE 'とんこつ' END, 5000)) || ' i' || page_id || '.png' AS other FROM m
UNION ALL SELECT 'crawl', source_id, '2026-04-23' FROM (SELECT DISTINCT page_id // 100 AS source_id FROM pages)""")
def ingest_pages(spark, d):
    """Every page told of by an item, most by its address and some without one, taken in with the pages at hand: articles
    with what of page and feed was kept, and the crawls."""
    rows, key = _read(spark, d, "pages"), F.col("page_id")
    link = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("<link>"), F.col("url"), F.when(key % 5 == 0, "#none").otherwise(""), F.lit("</link>")))
    item = F.concat(F.lit("<item><title>ラーメン「店"), key.cast("string"), F.lit("」オープン</title>"), link, F.lit("<description>とんこつ&lt;img src='i"), key.cast("string"), F.lit(".png'&gt;</description></item>"))
    feed = _feeds_of(rows.withColumn("source_id", F.expr("page_id div 100")), "page_id", item).withColumn("fetched_at", F.lit("2026-04-23").cast("timestamp"))
    known = feed.select(F.col("source_id").alias("id"), F.lit("東京都").alias("pref"), F.lit("北区").alias("city"), F.lit(True).alias("enabled"))
    nothing = lambda t: spark.createDataFrame([], SCHEMAS[t])
    out = ingest.ingest(feed, rows.select("url", "html"), known, nothing("articles"), nothing("stores"), F.lit("2026-04-23").cast("timestamp"), count_repeats=True)
    kept = out.articles.select(F.lit("article").alias("side"), "id", F.concat_ws(" ", "article_url", F.md5("content"), "thumbnail_url").alias("other"))
    return kept.union(out.crawls.select(F.lit("crawl"), "source_id", F.col("crawled_at").cast("date").cast("string")))


@query()
def ingest_batch(spark, d):
    """Every document with one of the texts as an item of its prefecture's feeds, ingested into empty tables: the stores made."""
    shown = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>"), shown("title"), F.lit("</title><link>https://news.example/"), F.col("id").cast("string"), F.lit("</link><description>"), shown("content"), F.lit("</description></item>"))
    place = F.array_position(F.array(*[F.lit(p) for p in words.PREFS]), F.col("pref"))
    rows = _long_texts(spark, d).where(place > 0).select((place + 10 * F.expr("id div 1000")).alias("source_id"), "pref", "id", item.alias("item"))
    known = rows.select(F.col("source_id").alias("id"), "pref").distinct().select("id", "pref", F.lit(None).cast("string").alias("city"), F.lit(True).alias("enabled"))
    written = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), "").alias("items"))
    feed = written.select("source_id", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml"), F.lit("2026-04-23").cast("timestamp").alias("fetched_at"))
    out = ingest.ingest(feed, _read(spark, d, "pages").select("url", "html"), known, spark.createDataFrame([], SCHEMAS["articles"]), spark.createDataFrame([], SCHEMAS["stores"]), F.lit("2026-04-23").cast("timestamp"))
    return out.stores.select("id", "name", "addr", "pref", "city", "tel_normalized", "genre", "open_date", "duplicate_flag", "nearest_station")
