"""Very long texts, empty tables, clashing names, crowded keys: cases that the operators' own tests leave out."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from kawara.llm import bpe, jaccard, quality, secrets, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_a_very_long_text_of_quality(spark):
    text = "the quick fox and the slow dog of it\n" * 40_000
    rows = spark.createDataFrame([(1, text), (2, "word " * 60)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.apply_rules(rows).select("doc_id", "quality.*", "passes").collect()}
    assert (got[1].n_words, got[1].n_lines, got[1].n_dup_lines) == (360_000, 40_000, 39_999) and got[1].n_repeat_words == 360_000 and not got[1].passes


def test_clashing_names_of_quality_and_redact(spark):
    rows = spark.createDataFrame([(1, "a token = abcdef0123456789 z", "q", "p", "s", 5)], "doc_id long, text string, QUALITY string, Passes string, secrets string, n_words int")
    out = quality.apply_rules(rows.drop("secrets"))
    assert [c.lower() for c in out.columns].count("quality") == 1 and out.first()["n_words"] == 5 and out.first().passes is False
    found = secrets.redact(secrets.scan(rows)).first()
    assert found.text == "a [SECRET] z" and (found.QUALITY, found.Passes, found.n_words) == ("q", "p", 5)


def test_no_rows_of_bpe(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, decoded string")
    out = bpe.encode(empty, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert out.columns == ["doc_id", "token_ids", "decoded"] and out.collect() == []
    assert bpe.decode(empty.select("doc_id", F.lit(None).cast("binary").alias("token_ids")), RANKS).collect() == []


def test_a_very_long_payload_and_a_crowded_second(spark):
    when = F.timestamp_seconds(F.lit(1_704_067_200))
    own = F.create_map(F.lit("etag"), F.concat(F.lit('"'), (F.col("id") % 50).cast("string"), F.lit('"')))
    first = spark.range(3000).select(F.col("id").alias("record_id"), F.lit("response").alias("record_type"), F.lit("http://a.example/x").alias("url"), when.alias("date"), F.lit(200).alias("status"), own.alias("headers"), F.when(F.col("id") == 2999, F.repeat(F.lit("long "), 400_000)).otherwise("p").alias("payload"))
    again = spark.range(3000, 6000).select(F.col("id").alias("record_id"), F.lit("revisit").alias("record_type"), F.lit("http://a.example/x").alias("url"), (when + F.expr("INTERVAL 1 SECOND")).alias("date"), F.lit(304).alias("status"), own.alias("headers"), F.lit(None).cast("string").alias("payload"))
    got = warc.resolve_revisits(first.unionByName(again), hot_records=100).collect()
    assert len(got) == 3000 and {r.response_id for r in got} == {2999}  # of one instant the largest id
    assert Counter(r.outcome for r in got) == {"resolved": 60, "mismatch": 2940}
    assert {len(r.payload) for r in got if r.outcome == "resolved"} == {2_000_000}


def test_a_shingle_that_most_texts_share(spark):
    """A notice in nine of ten short texts: no near copies by it alone, and those that there are are found."""
    unique = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string"))), " ")
    notice = F.when(F.col("id") % 10 == 0, "").otherwise(" this site uses cookies to work")
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(unique, notice).alias("text"))
    docs = docs.union(docs.where("doc_id % 1000 = 1").select(F.col("doc_id") + 50_000, F.concat("text", F.lit(" end"))))
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs, sample_texts=512).collect()}
    assert len(got) == 12_012 and {k: v for k, v in got.items() if k != v} == {50_001 + 1000 * k: 1 + 1000 * k for k in range(12)}


def test_a_very_long_text_of_near_copies(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
