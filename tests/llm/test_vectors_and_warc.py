"""Nearest vectors against brute force, and revisits against a plain as-of search."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kawara.llm import ann, warc


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = np.zeros(len(ids))
        for d in range(vectors.shape[1]):
            scores += vectors[ids.index(q), d] * vectors[:, d]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out[q] = [(ids[i], scores[i]) for i in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    got = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(want) and all(len(x) == 20 for x in by.values())
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in by.values())
    exact = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(exact.get((q, i), s) == s for q, x in by.items() for i, s in x)
    assert np.mean([len({i for i, _ in by[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_norms_and_copies(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(400, 8)) * rng.uniform(0.1, 5, (400, 1)), 3)
    vectors[100:200] = vectors[100]  # a hot vector: ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, bucket string")
    got = ann.search(df, df.where("vec_id % 10 = 0"), 20, chunk_rows=50).collect()
    want = brute(list(range(400)), vectors, range(0, 400, 10), 20)
    hits = [len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in x}) / 20 for q, x in want.items()]
    assert np.mean(hits) >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100][:3] == [i for i, _ in want[100]][:3]


def test_very_long_vectors(spark):
    """A few vectors of another order of length are found, and the others' neighbours aren't lost beside them."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8))
    vectors = centres[rng.integers(0, 20, 3000)] + 0.1 * rng.normal(size=(3000, 8))
    vectors[[5, 700]] *= 1e6
    vectors[9] *= 1e200
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 50 = 0"), 20, least_met=100).collect()
    with np.errstate(over="ignore"):
        want = brute(list(range(3000)), vectors, range(0, 3000, 50), 20)
    assert np.mean([len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in x}) / 20 for q, x in want.items()]) >= 0.95
    assert {r.vec_id for r in got if r.query_id == 700} >= {i for i, _ in want[700][:3]}


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, df, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, -1.0), (1, 1, 0, 0.5), (1, 2, 8, -0.5), (8, 1, 1, -0.5), (8, 2, 0, -1.0)]
    more = df.union(spark.createDataFrame([(20, [2.0]), (21, [-3.0]), (22, [1.0, 2.0, 3.0])], df.schema))
    assert [tuple(r) for r in ann.search(more, more, 20).where("query_id IN (7, 20, 21, 22)").orderBy("query_id", "rank").collect()] == [(7, 1, 20, 2.0), (7, 2, 21, -3.0), (20, 1, 7, 2.0), (20, 2, 21, -6.0), (21, 1, 7, -3.0), (21, 2, 20, -6.0)]
    named = df.select("*", *[F.lit("c").alias(n) for n in ("id", "vector", "bucket", "lists", "wide", "copy")])
    assert [tuple(r) for r in ann.search(named, named, 20).orderBy("query_id", "rank").collect()] == got
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://user@WWW.Example.com:80?utm_source=x&b=2&&a=1#top", "example.com/?a=1&b=2"),
        ("https://example.com:8080/A/", "example.com:8080/A/"),
        ("//m.example.com/x?", "m.example.com/x"),
        (" not a url ", "not a url"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc.canonical_url(F.col("url"))).first()[0] == want


def test_revisits(spark):
    start = datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        kind = "response" if rng.random() < 0.5 else "revisit"
        url = None if i % 50 == 7 else ("http://hot.example/" if rng.random() < 0.5 else f"https://www.hot.example/{rng.integers(4)}#f")
        date = None if i % 60 == 11 else start + timedelta(minutes=int(rng.integers(0, 600)))
        headers = {"ETag": f'"{rng.integers(3)}"'} if rng.random() < 0.7 else {"last-modified": str(rng.integers(2))} if rng.random() < 0.7 else None if rng.random() < 0.5 else {"Server": "s"}
        if headers is not None:
            headers = headers | {"Cache-Control": kind, "X": str(i)}
        rows.append((i, kind, url, date, int(rng.choice([200, 404])) if kind == "response" else 304, headers, f"body {i}"))
    df = spark.createDataFrame(rows, "record_id long, record_type string, url string, date timestamp, status int, headers map<string,string>, payload string").withColumn("bucket", F.lit(1))
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert len(got) == sum(r[1] == "revisit" for r in rows)
    key = lambda u: u and u.split("//")[1].removeprefix("www.").split("#")[0]
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, kind, url, date, status, headers, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if url and date and r[1] == "response" and r[4] == 200 and r[3] and r[3] < date and key(r[2]) == key(url)]
        of = max(before, key=lambda r: (r[3], r[0])) if before else None
        mine, theirs = low(headers), low(of[5]) if of else {}
        if of is None:
            want = "no_response"
        elif "etag" in mine and "etag" in theirs:
            want = "resolved" if mine["etag"] == theirs["etag"] else "mismatch"
        elif "last-modified" in mine and "last-modified" in theirs:
            want = "resolved" if mine["last-modified"] == theirs["last-modified"] else "mismatch"
        else:
            want = "no_validator"
        r = got[i]
        assert (r.outcome, r.response_id) == (want, of and of[0])
        if want == "resolved":
            assert r.payload == of[6] and r.status == 200 and r.headers["x"] == theirs["x"] and r.headers["cache-control"] == "revisit"
        else:
            assert r.payload is None and r.status == 304 and r.headers == mine


def test_profiles_ties_and_hot_urls(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    plain, same = warc.NOT_MODIFIED[0], "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    tag = lambda t: {"ETag": t}
    rows = [(1, "response", "http://a/", at(0), 200, tag("x"), "old", None), (1, "response", "http://a/", at(1), 200, tag("x"), "b", None), (1, "response", "http://a/", at(1), 200, tag("x"), "c", None)]
    rows += [(10 + i, "response", "http://a/", at(100 + i), 200, tag(f"t{i}"), f"p{i}", None) for i in range(50)]
    rows += [(200, "revisit", "http://a/", at(50), 304, tag("x"), None, plain), (201, "revisit", "http://a/", at(200), 304, tag("t49"), None, None), (202, "revisit", "http://a/", at(200), 200, tag("t49"), None, same), (203, "revisit", "http://a/", at(5000), 304, tag("t49"), None, plain), (204, "revisit", "http://a/", at(110), 304, tag("t9"), None, plain)]
    df = spark.createDataFrame(rows, "record_id long, record_type string, url string, date timestamp, status int, headers map<string,string>, payload string, profile string")
    for hot in (10, 1000):
        got = {r.record_id: (r.outcome, r.response_id, r.payload) for r in warc.resolve_revisits(df, hot_records=hot).collect()}
        assert got == {200: ("resolved", 1, "c"), 201: ("resolved", 59, "p49"), 202: ("other_profile", None, None), 203: ("resolved", 59, "p49"), 204: ("resolved", 19, "p9")}


def test_no_records(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], "record_id long, record_type string, url string, date timestamp, status int, headers map<string,string>, payload string")).count() == 0


@pytest.mark.parametrize("scale", [1e-30, 1e-12, 1.0, 1e18])
def test_rough_scores_at_every_scale(spark, scale):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 8)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = [i for i in range(3000) if i % 100 == 0]
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), 5, list_rows=100, least_met=3000).collect():
        got.setdefault(r.query_id, {})[r.rank - 1] = r.vec_id
    products = vectors[asked] @ vectors.T
    hits = 0
    for i, q in enumerate(asked):
        order = [j for j in np.argsort(-products[i], kind="stable") if j != q][:5]
        hits += len(set(order) & set(got[q].values()))
    assert hits == 5 * len(asked)
