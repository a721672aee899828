"""Changes that reach the tables, keys by hash, compaction: what is touched, what stays, what a dead run leaves."""

import glob
import os
from datetime import date, datetime

import pytest
from plans.test_ingest import FEEDS, PAGES, frame, tables
from pyspark.sql import functions as F

from kawara.plans import maintain
from kawara.sources.partitions import Partitioned, bins, tier
from kawara.sources.schema import BUCKETS, SCHEMAS, Tables
from kawara.streaming import poll


def filled(spark, table, rows, **columns):
    df = spark.createDataFrame(rows, "id long, batch long") if table != "store_articles" else spark.createDataFrame(rows, "store_id long, article_id long, batch long")
    df = df.withColumns(columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMAS[table]).schema.fields if f.name not in df.columns])


@pytest.fixture
def stored(spark, tmp_path):
    """Twelve stores and articles in four batches, by threes; store n is told of by articles n and n + 1; of store 5, store 6 may be a copy."""
    t = Tables(spark, str(tmp_path / "t")).create()
    rows = [(i, i // 3) for i in range(12)]
    t.append_batches("stores", filled(spark, "stores", rows, name=F.concat(F.lit("store"), F.col("id").cast("string")), listed_date=F.date_add(F.lit("2024-01-01").cast("date"), (30 * F.col("id")).cast("int")), duplicate_of_id=F.when(F.col("id") == 6, F.lit(5)), genre=F.lit("g")))
    t.append_batches("articles", filled(spark, "articles", rows, article_url=F.concat(F.lit("https://a/"), F.col("id").cast("string")), published_at=F.lit("2026-01-01").cast("timestamp"), title=F.lit("ラーメン")))
    t.append_batches("store_articles", filled(spark, "store_articles", [(i, a, i // 3) for i in range(12) for a in (i, i + 1)]))
    return t


def files(t, table):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{t.folder}/{table}/**/part-*", recursive=True)}


def ids(t, table, column="id"):
    return sorted(r[0] for r in t.read(table).select(column).collect())


def test_delete_writes_only_the_batches_it_hits(spark, stored):
    before = {n: files(stored, n) for n in ("stores", "store_articles", "articles")}
    stored.delete("stores", spark.createDataFrame([(4,), (4,), (5,), (99,), (None,)], "id long"))
    assert ids(stored, "stores") == [0, 1, 2, 3, 6, 7, 8, 9, 10, 11]
    assert sorted({r.store_id for r in stored.read("store_articles").collect()}) == [0, 1, 2, 3, 6, 7, 8, 9, 10, 11]
    assert stored.read("stores").where("id = 6").first().duplicate_of_id is None
    after = {n: files(stored, n) for n in before}
    kept = lambda n: {p.split("batch=")[1].split("/")[0] for p in before[n] if after[n].get(p) == before[n][p]}
    assert kept("stores") == {"-1", "0", "3"}  # the two in batch 1, and the one in batch 2 that named one of them
    assert kept("store_articles") == {"-1", "0", "2", "3"}
    assert after["articles"] == before["articles"] and not glob.glob(f"{stored.folder}/_pending/*")


def test_emptied_batches_go_and_unknown_ids_touch_nothing(spark, stored):
    before = files(stored, "stores")
    stored.delete("stores", spark.createDataFrame([(99,)], "id long"))
    assert files(stored, "stores") == before
    stored.delete("stores", spark.range(3, 6))
    assert sorted(stored.at["stores"].sizes()) == [-1, 0, 2, 3] and ids(stored, "stores") == [0, 1, 2, 6, 7, 8, 9, 10, 11]


def test_deleted_articles_are_known_no_more(spark, stored):
    urls = spark.range(12).selectExpr("concat('https://a/', id) AS url")
    stored.delete("articles", spark.createDataFrame([(0,), (7,)], "id long"))
    assert sorted(r[0] for r in stored.known(urls).collect()) == sorted(f"https://a/{i}" for i in range(12) if i not in (0, 7))
    assert {(r.store_id, r.article_id) for r in stored.read("store_articles").collect()} == {(i, a) for i in range(12) for a in (i, i + 1) if a not in (0, 7)}
    assert stored.top("articles") == 11 and stored.top("articles", 2) == 5 and stored.top("stores", 0) == 0


def test_update_and_reclassify(spark, stored):
    before = files(stored, "stores")
    stored.update("stores", spark.createDataFrame([(1, "x"), (99, "y"), (None, "z")], "id long, genre string"), stamp=("updated_at", F.lit("2026-02-01").cast("timestamp")))
    rows = {r.id: (r.genre, r.updated_at) for r in stored.read("stores").collect()}
    assert rows[1] == ("x", datetime(2026, 2, 1)) and all(v == ("g", None) for k, v in rows.items() if k != 1)
    assert {p for p in before if "batch=0" not in p} == {p for p in files(stored, "stores") if "batch=0" not in p}
    maintain.reclassify_in(stored, F.lit("2026-03-01").cast("timestamp"))
    assert {r.genre for r in stored.read("stores").collect()} == {"ラーメン"}


def test_clean_up_purge_and_reset(spark, stored):
    maintain.clean_up_in(stored, ["store1"])
    assert ids(stored, "stores") == [0, 2, 3, 4, 5, 6, 7, 8, 9]
    stored.purge(F.lit(date(2026, 5, 15)))
    assert ids(stored, "stores") == [5, 6, 7, 8, 9] and len(ids(stored, "articles")) == 12
    maintain.reset_in(stored)
    assert [stored.read(n).count() for n in ("stores", "articles", "store_articles")] == [0, 0, 0]
    assert stored.known(spark.createDataFrame([("https://a/1",)], "u string")).count() == 0 and stored.top("stores") == 11
    stored.append("stores", filled(spark, "stores", [(12, 0)]).drop("batch"), 5)
    assert ids(stored, "stores") == [12]


def test_a_run_that_dies(spark, stored, monkeypatch):
    gone, put = spark.range(4, 6), Partitioned.put
    monkeypatch.setattr(Partitioned, "put", lambda self, rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stored.at["stores"].replace(stored.at["stores"].read().where("id NOT IN (4, 5) AND batch = 1"), [1])
    monkeypatch.setattr(Partitioned, "put", put)
    assert len(ids(stored, "stores")) == 12  # listed whole, not yet in place
    stored.at["stores"].finish()
    assert ids(stored, "stores") == [i for i in range(12) if i not in (4, 5)]
    stored.at["stores"].finish()
    write = Partitioned.fitted
    monkeypatch.setattr(Partitioned, "fitted", lambda self, rows: write(self, rows.withColumn("id", F.raise_error(F.lit("lost")).cast("long"))))
    with pytest.raises(Exception, match="lost"):
        stored.delete("stores", gone.union(spark.range(1)))
    monkeypatch.undo()
    stored.at["stores"].finish()
    assert ids(stored, "stores") == [i for i in range(12) if i not in (4, 5)]


def test_compaction_of_many_batches(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t")).create()
    url = F.concat(F.lit("https://a/"), F.col("id").cast("string"))
    t.append_batches("articles", filled(spark, "articles", [(i, i // 3) for i in range(600)], article_url=url))
    t.append_batches("stores", filled(spark, "stores", [(i, i) for i in range(200)]))
    t.append_batches("crawls", spark.range(400).selectExpr("id % 3 AS source_id", "timestamp_seconds(id) AS crawled_at", "id % 200 AS batch"))
    every = spark.range(600).selectExpr("concat('https://a/', id) AS url")
    assert len(t.at["articles"].sizes()) == 201
    for _ in range(2):
        t.compact(200)
        assert sorted(t.at["articles"].sizes()) == [-1, 199] and sorted(t.at["article_keys"].sizes()) == [-1, 199]
        assert len(files(t, "articles")) == 2 and len(files(t, "article_keys")) <= BUCKETS + 1
        assert ids(t, "articles") == list(range(600)) and t.known(every).count() == 600 and t.top("articles") == 599
        assert t.read("crawls").count() == 3 and max(r.crawled_at for r in t.read("crawls").collect()) == datetime(1970, 1, 1, 0, 6, 39)
    t.append("articles", filled(spark, "articles", [(600, 0)], article_url=url).drop("batch"), 200)
    t.append("articles", filled(spark, "articles", [(601, 0)], article_url=url).drop("batch"), 200)  # the batch is run again
    assert ids(t, "articles") == [*range(600), 601] and t.top("articles") == 601 and t.top("articles", 200) == 599
    asked = spark.createDataFrame([("https://a/7",), ("https://a/601",), ("https://a/600",), ("https://no/",)], "link string")
    assert {r[0] for r in t.known(asked).collect()} & {r[0] for r in asked.collect()} == {"https://a/7", "https://a/601"}
    assert {r[0] for r in t.known(asked, 200).collect()} & {r[0] for r in asked.collect()} == {"https://a/7"}


def test_only_the_hashes_asked_for_are_read(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t")).create()
    t.append_batches("articles", filled(spark, "articles", [(i, i // 30) for i in range(600)], article_url=F.concat(F.lit("https://a/"), F.col("id").cast("string"))))
    t.compact(20, least=2)
    asked = spark.createDataFrame([("https://a/7",), ("https://a/9",)], "link string")
    known = t.known(asked)
    used = {f"bucket={r[0]}" for r in asked.selectExpr(f"pmod(xxhash64(link), {BUCKETS})").collect()}
    for p in glob.glob(f"{t.folder}/article_keys/batch=19/*/part-*"):
        if p.split("/")[-2] not in used:
            open(p, "wb").write(b"unreadable")
            os.path.exists(crc := os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")) and os.remove(crc)
    assert {r[0] for r in known.collect()} >= {"https://a/7", "https://a/9"} and t.known(asked).count() < 60


def test_bins():
    assert bins({b: 10 for b in range(3)}, 100, 4) == [] and bins({}, 100, 1) == []
    assert bins({0: 10, 1: 60, 2: 10, 3: 49, 4: 40, 5: 45}, 100, 4) == [[0, 2, 3], [4, 5]]
    assert bins({0: 49, 1: 49, 2: 49}, 100, 2) == [[0, 1]]


def test_tier():
    assert tier({}, 0) == [] and tier({0: 1}, 0) == [] and tier({b: 60 << 20 for b in range(40)}, 16) == [list(range(40))]
    assert tier({0: 1000, 1: 10, 2: 30, 3: 10, 4: 60}, 2) == [[1, 3]] and tier({0: 1000, 1: 10, 2: 20, 3: 10}, 3) == [[1, 2, 3]] and tier({0: 1, 1: 1}, 3) == []


def test_large_batches_become_one(spark, tmp_path, monkeypatch):
    """Forty batches that are too large together for one file are still one batch, of several files."""
    t = Tables(spark, str(tmp_path / "t")).create()
    t.append_batches("articles", filled(spark, "articles", [(i, i % 40) for i in range(400)], article_url=F.concat(F.lit("https://a/"), F.col("id").cast("string"))))
    sizes = Partitioned.sizes
    monkeypatch.setattr(Partitioned, "sizes", lambda self: {b: 4096 * n for b, n in sizes(self).items()})
    t.compact(40)
    assert sorted(t.at["articles"].sizes()) == [-1, 39] and sorted(t.at["article_keys"].sizes()) == [-1, 39]
    assert ids(t, "articles") == list(range(400)) and len(files(t, "articles")) > 1


def test_polls_compact(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    found = []
    for least in (2, 100):
        t = tables(spark, tmp_path / f"t{least}")
        for k in range(3):
            frame(spark, [FEEDS[k], FEEDS[0]]).write.mode("append").parquet(str(tmp_path / f"f{least}"))
            poll.poll(spark, str(tmp_path / f"f{least}"), pages, t, str(tmp_path / f"c{least}"), compact_from=least).awaitTermination()
        found.append([sorted(map(str, t.read(n).drop("created_at", "updated_at", "crawled_at").distinct().collect())) for n in ("articles", "stores", "store_articles", "crawls")])
        assert sorted(t.at["articles"].sizes()) == ([-1, 1, 2] if least == 2 else [-1, 0, 1, 2])
    assert found[0] == found[1]
