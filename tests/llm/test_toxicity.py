"""Toxicity: accuracy on rows that were held out, features of single texts, labels and texts of every odd kind."""

import zlib
from bisect import bisect_left, bisect_right

import pytest

from kawara.llm import queries, toxicity

NAMES = toxicity.FEATURES


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op13_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic, clean = (sorted(r.score for r in rows if r.held_out and labels.get(r.doc_id) == y) for y in (1, 0))
    area = sum(bisect_left(clean, x) + bisect_right(clean, x) for x in toxic) / 2 / len(toxic) / len(clean)
    assert area > 0.98
    assert sum(x >= 0.3 for x in toxic) >= 0.92 * len(toxic) and sum(x >= 0.3 for x in clean) <= 0.02 * len(clean)


@pytest.fixture(scope="module")
def small(spark):
    good, bad = "the river runs past the old mill and on to the sea", "you are a zorgish zorgo, what a frubble you have made"
    texts = [(k, f"{good} {k}", 0) for k in range(120)] + [(200 + k, f"{bad} {good} {k}", 1) for k in range(60)]
    return spark.createDataFrame(texts, "doc_id long, text string, toxic int")


def test_odd_rows(spark, small):
    labels = small.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7), (201, 0), (9999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(small.select("doc_id", "text"), labels)
    assert "zorgo" in model.weights and "river" not in model.weights
    rows = [(1, None, "kept"), (2, "", "kept"), (3, " \n\t", "kept"), (None, "ZORGISH zorgo frubble!", "kept"), (5, "the old mill", "kept"), (5, "the old mill", "kept"), (6, "river " * 50_000, "kept"), (7, "zorgish " * 50_000, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string").selectExpr("*", "'x' AS score", "1 AS toxicity__score_", "2 AS y")
    got = model.score(docs).collect()
    assert len(got) == len(rows) and {r.found for r in got} == {"kept"} and {(r.toxicity__score_, r.y) for r in got} == {(1, 2)}
    by = {(r.doc_id, (r.text or "")[:12]): r.score for r in got}
    assert by[1, ""] == by[2, ""] and by[None, "ZORGISH zorg"] > 0.5 > by[5, "the old mill"]
    assert by[7, "zorgish zorg"] > 0.5 > by[6, "river river "]
    assert model.score(docs.limit(0)).count() == 0


def test_labels_of_one_class(spark, small):
    docs = small.select("doc_id", "text")
    for labels, want in ((small.limit(0), 0.0), (small.where("toxic = 1"), 1.0), (small.where("toxic = 0"), 0.0)):
        assert {r.score for r in toxicity.fit(docs, labels).score(docs).collect()} == {want}


def test_bounded_sample(spark, small):
    assert toxicity.fit(small.select("doc_id", "text"), small, train_rows=90).trees is not None


def test_features():
    lexicon = toxicity.Lexicon({"idiot": (2.0, True), "zor*": (1.0, False), "zorgisch": (3.0, True)})
    of = lambda text: dict(zip(NAMES, toxicity.features(text, lexicon)))
    assert set(of("").values()) == {0.0} and set(of(" \n").values()) == {0.0}
    got = of("You are an IDIOT! really, zorgette and zorgisch")
    assert got["strong_density"] == 2 / 8 and got["hit_density"] == 3 / 8 and got["heaviest"] == 3.0 and got["weight_density"] == 6 / 8
    assert got["near_second_person"] == 2 / 8 and got["second_person"] == 1 / 8 and got["shouted_words"] == 1 / 8 and got["masked_words"] == 0
    masked = of("such 1d1ots and id!ot, i d i o t")
    assert masked["masked_hits"] == 2 / 9 and masked["masked_words"] == 3 / 9
    assert toxicity.core("«Idi0t!»") == "idiot" and toxicity.core("...") == "" and toxicity.terms("idiotic") == ["idiotic", "idioti*", "idiot*", "idio*", "idi*"]


def test_counts_of_terms(spark):
    docs = spark.createDataFrame([("Ab ab. abcd", 0), ("abcd xyz", 1), (None, 1), ("abcd", 1)], "text string, g int")
    for room in (400_000, 1):
        assert {r.term: r.n for r in toxicity.term_counts(docs, "text", "g", 2, room).collect()} == {"ab": [1, 0], "abcd": [1, 2], "abc*": [1, 2], "xyz": [0, 1]}
