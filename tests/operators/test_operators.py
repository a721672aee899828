"""Resolution, changes and serving on small tables."""

import random
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kawara.operators import changes, durable, resolve, serving, similar
from kawara.plans import views

ITEM = "rank long, tel_normalized string, name_normalized string, pref string, city string"
STORE = "id long, tel_normalized string, name_normalized string, pref string, city string"


def resolved(spark, items, stores, similar="token", **more):
    out = resolve.resolve(spark.createDataFrame(items, ITEM), spark.createDataFrame(stores, STORE), similar=similar, **more).orderBy("rank").collect()
    return [(r.outcome, r.store_id, r.duplicate_of_id) for r in out]


def want(items, stores, similar="token"):
    as_dict = lambda names, row: dict(zip(names, row))
    keys = ("tel_normalized", "name_normalized", "pref", "city")
    return resolve.resolve_one_by_one([as_dict(("rank", *keys), x) for x in sorted(items)], [as_dict(("id", *keys), x) for x in stores], similar)


def test_leader_is_no_component(spark):
    items = [(1, "t1", "x", "p", "c"), (2, "t1", "y", "p", "c"), (3, None, "y", "p", "c")]
    assert resolved(spark, items, []) == [("new", 1, None), ("merged", 1, None), ("new", 2, None)]


NAMES = st.sampled_from(["cafe", "cafe-bar", "bar cafe", "x", "", "麺屋さ", "麺屋さ・くら", "cafebar"])
TELS = st.sampled_from([None, None, "1", "2", "3", "4"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(TELS, NAMES, st.sampled_from(["p", "q"])), max_size=14), st.lists(st.tuples(TELS, NAMES), max_size=4))
def test_same_as_one_by_one(spark, rows, old):
    items = [(i, t, n, p, "c") for i, (t, n, p) in enumerate(rows)]
    stores = [(10 + i, t, n, "p", "c") for i, (t, n) in enumerate(old)]
    assert resolved(spark, items, stores) == want(items, stores)
    assert resolved(spark, items, stores, fold_rows=0) == want(items, stores)


@pytest.mark.parametrize(("way", "first"), [("token", None), ("prefix", 1), ("part", 1)])
def test_ways_of_a_soft_match(spark, way, first):
    names = ["麺屋さくら本店", "新麺屋さくら", "麺屋さくら柏店", "麺", "の麺屋さ", ""]
    items = [(i, None, n, "p", "c") for i, n in enumerate(names)]
    got = resolved(spark, items, [], way)
    assert got == want(items, [], way) and got[2][2] == first


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_soft_match_by_similar_names(spark, threshold):
    rng = random.Random(4)
    words = ["麺屋", "さくら", "本店", "cafe", "bar", "ひなた", "二号"]
    items = [(i, None, "".join(rng.choices(words, k=rng.randint(0, 4))) or None, rng.choice("pq"), "c") for i in range(60)]
    stores = [(10 + i, None, "".join(rng.choices(words, k=2)), rng.choice("pq"), "c") for i in range(8)]
    got = resolved(spark, items, stores, threshold)
    assert got == want(items, stores, threshold) and (threshold > 0.5 or {"soft", "new"} <= {o for o, *_ in got})


@pytest.mark.parametrize("threshold", [0.25, 0.6, 1.0])
def test_similar_names_are_those_of_every_pair(spark, threshold):
    rng = random.Random(9)
    names = ["", None, "a", "ab", "aaaa", "aaaaa", *["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)], *["hot name"] * 20]
    rows = [(rng.choice(["p", "q", None]), "c", n) for n in names]
    df = spark.createDataFrame(rows, "pref string, city string, name string")
    got = {(r.pref, r.left_name, r.right_name): r.similarity for r in similar.similar_names(df, df, threshold=threshold).collect()}
    grams = lambda n: {f"  {n} "[k : k + 3] for k in range(len(n) + 1)}
    share = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = {(p, a, b): share(a, b) for p, _, a in rows for q, _, b in rows if p and p == q and a and b and share(a, b) >= threshold - 1e-9}
    assert got == want and len(got) > 20
    assert similar.similar_names(df.limit(0), df, threshold=threshold).count() == 0


@pytest.mark.parametrize("more", [{}, {"fold_rows": 0}])
def test_a_chain(spark, more):
    """Each item shares a key with the next one: every other one leads."""
    n = 10_000 if not more else 600
    items = [(i, f"t{i // 2}", f"n{(i + 1) // 2}", "p", "c") for i in range(n)]
    spark.sparkContext.setJobGroup("chain", "")
    got = {r.rank: r.leads for r in resolve.leaders(spark.createDataFrame(items, ITEM), keys=("tel_normalized", "name_normalized"), **more).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}
    if not more:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_upsert_without_an_order_is_fixed(spark):
    table = spark.createDataFrame([(1, "u", "a", 0)], "id long, url string, name string, n int")
    rows = spark.createDataFrame([("u", "b", 2), ("u", "c", 1), ("u", "a", 9)], "url string, name string, n int")
    assert [tuple(r) for r in changes.upsert(table, rows, ["url"]).collect()] == [(1, "u", "c", 1)]


def test_a_hot_name(spark):
    items = [(i, None if i % 3 else str(i), "hot" if i % 2 else f"n{i}", "p", "c") for i in range(300)]
    assert resolved(spark, items, []) == want(items, [])


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.n for r in durable.numbered(df, [F.col("k")], "n", 5).collect()}
    assert got == {k: k + 5 for k in range(1000)}
    assert durable.numbered(df.limit(0), [F.col("k")], "n").count() == 0


def test_upsert_keeps_what_is_not_supplied(spark):
    table = spark.createDataFrame([(1, "u1", "a", True, datetime(2026, 1, 1)), (2, "u2", "b", False, None)], "id long, url string, name string, enabled boolean, seen timestamp")
    rows = spark.createDataFrame([("u2", "B", 1), ("u3", "c", 1), ("u3", "C", 2), (None, "n", 1)], "url string, name string, ord int")
    out = changes.upsert(table, rows.drop("ord"), ["url"], order=None, defaults={"enabled": F.lit(True)})
    ordered = changes.upsert(table, rows, ["url"], order=F.col("ord"), defaults={"enabled": F.lit(True)})
    got = {r.url: (r.id, r.name if "name" in r else r["name"], r.enabled) for r in ordered.collect()}
    assert got["u1"] == (1, "a", True) and got["u2"] == (2, "B", False) and got["u3"][1:] == ("C", True) and {got["u3"][0], got[None][0]} == {3, 4}
    again = changes.upsert(ordered, rows.where("url IS NOT NULL"), ["url"], order=F.col("ord"))
    assert sorted(map(str, again.collect())) == sorted(map(str, ordered.collect())) and out.count() == 4


def test_bridge_upsert(spark):
    links = spark.createDataFrame([(1, 1)], "store_id long, article_id long")
    assert changes.upsert(links, spark.createDataFrame([(1, 1), (1, 2)], links.schema), ["store_id", "article_id"]).count() == 2


def test_delete_purge_truncate(spark):
    stores = spark.createDataFrame([(1, "a", date(2020, 1, 1), None), (2, "b", date(2026, 1, 1), 1), (3, "c", date(2026, 1, 1), 2)], "id long, name string, listed_date date, duplicate_of_id long")
    articles = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2026, 1, 1))], "id long, published_at timestamp")
    links = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2)], "store_id long, article_id long")
    kept, read, joined = changes.purge(stores, articles, links, F.lit("2026-04-01").cast("date"))
    assert sorted((r.id, r.duplicate_of_id) for r in kept.collect()) == [(2, None), (3, 2)]
    assert [r.id for r in read.collect()] == [2] and sorted(map(tuple, joined.collect())) == [(2, 2), (3, 2)]
    left, rest = changes.delete_stores(stores, links, spark.createDataFrame([(2,)], "id long"))
    assert left.count() == 2 and sorted(map(tuple, rest.collect())) == [(1, 1), (3, 2)]
    assert changes.truncate(stores).count() == 0 and changes.truncate(stores).schema == stores.schema


def test_update_stamps(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, genre string, at int")
    out = changes.update(table, spark.createDataFrame([(2, "c")], "id long, genre string"), stamp=("at", F.lit(9)))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 0), (2, "c", 9)]


def today():
    return F.lit("2026-04-23").cast("date")


@pytest.fixture(scope="module")
def rows(spark):
    stores = [
        (1, "A", None, "東京都", "北区", "03", "ラーメン", None, date(2026, 4, 25), date(2026, 4, 20), None, False, None),
        (2, "B", "addr", "東京都", "北区", None, None, "立川駅", None, date(2026, 4, 1), "t.png", True, 1),
        (3, "C", "addr", "千葉県", "柏市", "04", "カフェ", None, date(2026, 4, 1), date(2026, 5, 1), None, False, 0),
        (4, "D", None, "北海道", "札幌", None, "居酒屋", None, date(2026, 4, 20), date(2026, 4, 20), None, False, None),
    ]
    schema = "id long, name string, addr string, pref string, city string, tel string, genre string, nearest_station string, open_date date, listed_date date, thumbnail_url string, duplicate_flag boolean, duplicate_of_id long"
    articles = spark.createDataFrame([(1, 1, "u1", "first", datetime(2026, 4, 1)), (2, 2, "u2", "second", datetime(2026, 4, 1)), (3, None, "u3", "A", datetime(2026, 3, 1))], "id long, source_id long, article_url string, title string, published_at timestamp")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (3, 99)], "store_id long, article_id long")
    sources = spark.createDataFrame([(1, "s1", "独立系ブログ"), (2, "s2", "経済新聞")], "id long, name string, source_type string")
    return views.serving_rows(views.stores_with_sources(spark.createDataFrame(stores, schema), links, articles, sources))


def ids(df):
    return [r.id for r in df.collect()]


def test_serving_rows(rows):
    got = {r.id: r for r in rows.collect()}
    assert [s["url"] for s in got["1"].sources] == ["u2", "u1", "u3"] and got["1"].article_title == "second" and got["1"].sources[2]["name"] is None
    assert got["3"].sources == [] and got["3"].article_title is None and got["3"].duplicate_of_id is None and got["2"].duplicate_of_id == "1"
    assert (got["2"].genre, got["2"].tel, got["2"].open_date, got["1"].addr) == ("その他", "", "", "")


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({}, "1234"),
        ({"pref": "東京都"}, "12"),
        ({"pref": "東京都", "pinned_pref": "千葉県"}, "3"),
        ({"city": "北区", "within_days": 3}, "1"),
        ({"within_days": 3}, "134"),
        ({"genre": "その他"}, "2"),
        ({"source_type": "経済新聞"}, "1"),
        ({"source_name": "s1", "require_tel": True}, "1"),
        ({"require_addr": True}, "23"),
    ],
)
def test_filters(rows, filters, want):
    assert "".join(sorted(ids(serving.apply_filters(rows, serving.Filters(**filters), today())))) == want


def test_hidden(spark, rows):
    hidden = serving.hidden_ids(spark.createDataFrame([('["1","9"]',), ("broken",), (None,)], "hidden string"))
    assert sorted(ids(serving.apply_filters(rows, serving.Filters(), today(), hidden))) == ["2", "3", "4"]
    assert len(ids(serving.apply_filters(rows, serving.Filters(show_hidden=True), today(), hidden))) == 4
    assert serving.hidden_count(rows, hidden).first().n == 1


@pytest.mark.parametrize(("order", "want"), [("date-desc", "3142"), ("date-asc", "2143"), ("open-desc", "1432"), ("open-asc", "3412"), ("pref", "4123"), ("genre", "3214")])
def test_orders(rows, order, want):
    got = "".join(ids(serving.apply_order(rows, order)))
    assert got == want


def test_filter_state():
    f = serving.Filters(pref="東京都", city="北区", order="genre", show_hidden=True)
    assert f.choose_pref("千葉県").city == "" and f.reset() == serving.Filters(show_hidden=True)
    assert serving.Filters(pinned_pref="千葉県", order="pref").reset() == serving.Filters(pinned_pref="千葉県")
    with pytest.raises(ValueError, match="order"):
        serving.Filters(order="x")


def test_facets(spark):
    stores = spark.createDataFrame([(1, "東京都", "北区", "寿司"), (2, "東京都", "中央区", None), (3, "千葉県", "柏市", "カフェ")], "id long, pref string, city string, genre string")
    links = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (9, 4)], "store_id long, article_id long")
    articles = spark.createDataFrame([(1, 1), (2, 2), (3, 7), (4, 3)], "id long, source_id long")
    sources = spark.createDataFrame([(1, "s2"), (2, "s1"), (3, "unread")], "id long, name string")
    got = views.facets(stores, links, articles, sources, "東京都").orderBy("facet", "position").collect()
    assert [tuple(r) for r in got] == [("city", "中央区", 1), ("city", "北区", 2), ("genre", "その他", 1), ("genre", "カフェ", 2), ("genre", "寿司", 3), ("source", "s1", 1), ("source", "s2", 2), ("source", None, 3)]


def test_cards(rows):
    got = {r.key: r for r in serving.cards(rows, today()).collect()}
    assert (got["1"].heading, got["1"].shop, got["1"].more, got["1"].opening, got["1"].place, got["1"].phone) == ("second", "A", "+2件", "🎉 04/25 オープン予定（あと2日）", "住所未抽出", "📞 03")
    assert (got["2"].heading, got["2"].shop, got["2"].station, got["2"].colour, got["2"].badge) == ("A", "B", "🚃 最寄: 立川駅", "#6b7280", "掲載 04/01")
    assert (got["3"].heading, got["3"].source, got["3"].opening, got["4"].opening) == ("C", None, "🎉 04/01 オープン", "🎉 04/20 オープン（3日前）")


def test_scratch_is_deleted(spark):
    with durable.scratch(spark):
        one = durable.durable(spark.range(3))
        with durable.scratch(spark):
            two = durable.durable(spark.range(4))
            assert two.count() == 4
        assert one.count() == 3
        with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_FOUND|FAILED_READ"):
            two.collect()
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_FOUND|FAILED_READ"):
        one.collect()


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf(dict):
        pass

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf({"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        durable.shared_folder(Session())
    Session.conf["spark.sql.warehouse.dir"] = "hdfs://n/warehouse"
    assert durable.shared_folder(Session()).startswith("hdfs://n/warehouse/kawara_shared/")
    Context.master, Session.conf["spark.sql.warehouse.dir"] = "local[4]", "/tmp/w"
    assert durable.shared_folder(Session()).startswith("/tmp/w/kawara_shared/")


def test_rare_trigrams_are_dealt_by_number(spark):
    """The join on rare trigrams has parts by rows, which adaptive execution doesn't make few by their bytes."""
    rows = spark.range(3000).selectExpr("'p' AS pref", "'c' AS city", "concat('n', id * 7919) AS name")
    plan = similar.similar_names(rows, rows, threshold=0.9)._jdf.queryExecution().analyzed().toString()
    assert plan.count("RepartitionByExpression [pref") == 2
