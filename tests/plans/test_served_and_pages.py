"""The stored view against a rebuilt one, keyset pages against slices, counters, and a stream that forgets."""

import glob
import os
import random
from datetime import date, timedelta

import pytest
from plans.test_ingest import FEEDS, PAGES, frame, tables
from pyspark.sql import functions as F

from kawara.plans import ingest, pages, served, views
from kawara.streaming import poll


def shown(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def rebuilt(t):
    return shown(views.stores_with_sources(t.read("stores"), t.read("store_articles"), t.read("articles"), t.read("sources")))


def test_view_follows_polls_and_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(served, "PER_PART", 2)
    t, pages_ = tables(spark, tmp_path / "t"), spark.createDataFrame(PAGES, "url string, html string")
    served.rebuild(t)
    assert served.view(t).count() == 0
    for k, feeds in enumerate((FEEDS[:1], FEEDS)):
        frame(spark, feeds).write.mode("append").parquet(str(tmp_path / "f"))
        poll.poll(spark, str(tmp_path / "f"), pages_, t, str(tmp_path / "c"), view=True).awaitTermination()
        assert shown(served.view(t)) == rebuilt(t), k
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{t.folder}/served/**/part-*", recursive=True)}
    served.merge_batch(t, 1)  # again
    assert shown(served.view(t)) == rebuilt(t) and rebuilt(t)
    t.delete("stores", spark.createDataFrame([(1,)], "id long"))
    served.refresh(t, spark.createDataFrame([(1,), (99,)], "id long"))
    assert shown(served.view(t)) == rebuilt(t)
    kept = [p for p in before if "batch=1" in p or "batch=2" in p]
    assert kept and all(os.path.exists(p) for p in kept)  # other partitions keep their files
    served.rebuild(t)
    assert shown(served.view(t)) == rebuilt(t)


def test_counts_are_those_of_a_second_pass(spark, tmp_path):
    t, pages_ = tables(spark, tmp_path), spark.createDataFrame(PAGES, "url string, html string")
    out = ingest.ingest(frame(spark, FEEDS), pages_, t.sources(), t.read("articles"), t.read("stores"), F.lit("2026-04-23").cast("timestamp"))
    made, linked, taken = out.stores.count(), out.links.count(), out.articles.count()
    assert {r.status: r.n for r in out.counts.collect()} == {"added": made, "merged": linked - made, "chain": 1, "incomplete": taken - linked - 1}
    nothing = ingest.ingest(frame(spark, []), pages_, t.sources(), t.read("articles"), t.read("stores"), F.lit("2026-04-23").cast("timestamp"))
    assert nothing.counts.collect() == []


KEYS = [pages.Key("day", True), pages.Key("name"), pages.Key("id")]


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *(date(2024, 1, 1) + timedelta(days=d) for d in range(9))]), rng.choice([None, "a", "b", "c"])) for i in range(1000)]
    folder = str(tmp_path_factory.mktemp("pages"))
    pages.lay_out(spark.createDataFrame(rows, "id long, day date, name string"), KEYS, folder, files=20)
    order = lambda r: (r[1] is None, -(r[1].toordinal() if r[1] else 0), r[2] is None, r[2] or "", r[0])
    return folder, [r[0] for r in sorted(rows, key=order)]


def test_pages_are_slices(spark, laid):
    folder, want = laid
    got, last = [], None
    for _ in range(12):
        rows = pages.page(spark, folder, KEYS, 93, last).collect()
        got += [r.id for r in rows]
        last = rows[-1].asDict() if rows else last
    assert got == want
    assert [r.id for r in pages.page(spark, folder, KEYS, 5, {"day": date(2030, 1, 1), "name": None, "id": 0}).collect()] == want[:5]
    assert pages.page(spark, folder, KEYS, 5, {"day": None, "name": None, "id": 10**6}).collect() == []


def files_read(df):
    """Files that the scans of a plan have read."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        if plan.metrics().contains("numFiles"):
            n += plan.metrics().apply("numFiles").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
    return n


def test_a_late_page_reads_as_few_files_as_the_first(spark, laid):
    folder, want = laid
    rows = {r.id: r.asDict() for r in spark.read.parquet(f"{folder}/rows").collect()}
    read = [files_read(pages.page(spark, folder, KEYS, 20, last)) for last in (None, rows[want[479]], rows[want[900]])]
    assert 1 <= min(read) and max(read) <= 3 < 10 < len(glob.glob(f"{folder}/rows/part=*"))


def test_an_empty_list(spark, tmp_path):
    pages.lay_out(spark.createDataFrame([], "id long, day date, name string"), KEYS, str(tmp_path), files=3)
    assert pages.page(spark, str(tmp_path), KEYS, 5).collect() == []


def test_append_new_with_bounded_state(spark, tmp_path):
    rows = lambda ids, minute: spark.createDataFrame([(i,) for i in ids], "id long").withColumn("at", F.timestamp_seconds(F.lit(60 * minute) + F.col("id")))
    for ids, minute in ((range(10), 0), (range(5, 15), 1), (range(3), 600)):
        rows(ids, minute).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    poll.append_new(stream, "id", "at", str(tmp_path / "out"), str(tmp_path / "c"), at="at", within="10 minutes").awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == list(range(15))  # what the stream has forgotten, the table still holds
