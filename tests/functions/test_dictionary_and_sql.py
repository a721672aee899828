"""Words of a table against words folded into an expression; text functions called from SQL."""

import random

from pyspark.sql import functions as F

from kawara.functions import dictionary, html, sql, text, words


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_words_of_a_table(spark):
    found = dictionary.find_words(rows(spark, ["abcab", "", None, "bb bbb", "xaby", "ab"]), spark.createDataFrame([("ab",), ("bb",), ("ab",), ("",), (None,), ("abcabc",), ("b",)], "word string"))
    assert {(r.id, r.word): r.n for r in found.collect()} == {(0, "ab"): 2, (0, "b"): 2, (3, "bb"): 3, (3, "b"): 5, (4, "ab"): 1, (4, "b"): 1, (5, "ab"): 1, (5, "b"): 1}
    nothing = dictionary.find_words(rows(spark, ["a"]), spark.createDataFrame([], "word string"))
    assert nothing.columns == ["id", "word", "n"] and nothing.collect() == []


def test_same_as_the_folded_expressions(spark):
    rng = random.Random(1)
    listed = [w for ws in words.GENRES.values() for w in ws]
    texts = ["".join(rng.choices([*listed, "、", "店", "x"], k=rng.randint(0, 30))) for _ in range(80)] + [None, ""]
    df = rows(spark, texts)
    table = spark.createDataFrame([(label, w, i) for i, (label, ws) in enumerate(words.GENRES.items()) for w in ws], "label string, word string, order int")
    got = {r.id: r.label for r in dictionary.best_label(df, table).collect()}
    assert got == {r.id: r.label for r in df.select("id", text.best_label(F.col("text"), words.GENRES).alias("label")).collect()}
    held = {r.id: r.food for r in dictionary.with_any(df, spark.createDataFrame([(w,) for w in words.FOOD], "word string"), "food").collect()}
    assert held == {r.id: bool(r.food) for r in df.select("id", text.any_of(F.col("text"), words.FOOD).alias("food")).collect()}


def test_words_across_stretches(spark):
    """A word at every place around the ends of stretches, and in a text as long as a book."""
    word = "ぁ🙂x"
    texts = ["・" * n + word + "・" * (n % 3) for n in range(130)] + [("・" * 1000 + word) * 1000]
    found = dictionary.find_words(rows(spark, texts), spark.createDataFrame([(word,), ("no" * 40,), ("x",)], "word string"))
    got = {(r.id, r.word): r.n for r in found.collect()}
    assert got == {(i, w): 1 if i < 130 else 1000 for i in range(131) for w in (word, "x")}


def test_a_hundred_thousand_words(spark):
    table = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(";")).alias("word"))
    df = spark.range(200).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("w"), (F.col("id") * 997 + i * 31).cast("string"), F.lit(";"))), " ").alias("text"))
    found = dictionary.find_words(df, table)
    assert found.count() == sum(1 for i in range(200) for j in range(50) if i * 997 + j * 31 < 100_000)


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    one = lambda q: spark.sql(f"SELECT {q}").first()[0]
    assert one("normalize_name('株式会社 Cafe & Bakery TSUBAME（本店）')") == "cafe&bakerytsubame"
    assert one("extract_open_date('オープン日：2026/5/1', 2026)") == "2026-05-01"
    assert one("extract_store_name('千葉駅から徒歩10分に7/3オープン、KARUKARIで頂くポークビンダルーカレー')") == "KARUKARI"
    assert one("extract_address('場所は渋谷区道玄坂2-10-7です', '東京都')") == "東京都渋谷区道玄坂2-10-7"
    assert one("is_chain_store('丸亀製麺 駅前店')") is True and one("extract_pref(NULL)") is None
    titles = [None, "", "ラーメン一番が閉店、隣駅へ移転オープン", "「新店」麺屋さくら オープン", "<p>a &amp; b</p><img src='i.png'>", "東京都千葉駅から"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    df.createOrReplaceTempView("titles")
    calls = {"normalize_text(t)": text.normalize_text, "extract_store_name(t)": text.extract_store_name, "extract_station(t)": text.extract_station, "strip_html(t)": html.strip_html, "first_image(t)": html.first_image, "is_food_opening(t, t)": lambda c: text.is_food_opening(c, c)}
    got = spark.sql(f"SELECT {', '.join(f'{c} AS c{i}' for i, c in enumerate(calls))} FROM titles")
    assert got.collect() == df.select(*[f(F.col("t")).alias(f"c{i}") for i, f in enumerate(calls.values())]).collect()
    assert "Python" not in got._jdf.queryExecution().toString()


def test_windows_stay_where_words_are_few(spark):
    """Windows of texts meet the words without a shuffle; what is found is shuffled alone."""
    words = spark.createDataFrame([("ab",), ("c",)], "word string")
    rows = spark.createDataFrame([(1, "abcab"), (2, "zz")], "id long, text string")
    found = dictionary.find_words(rows, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "ab", 2), (1, "c", 1)]
