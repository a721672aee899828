"""Words of a table found in texts, however many they are: windows of the words' lengths, joined on equal text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many characters that words begin with are looked for in a text before its windows are taken.
FIRST_CHARACTERS = 4096
#: Up to so many words go to every task; more are dealt by word, and so are the windows.
SENT_WORDS = 1 << 16
#: Places in a stretch of text; it also has what words that begin at the last of them may need.
STRETCH = 64


def find_words(rows: DataFrame, words: DataFrame, *, key: str = "id", text: str = "text", word: str = "word") -> DataFrame:
    """(key, word, n): how often each word of ``words`` stands in each text, overlapping occurrences counted each.

    A text is gone through once whatever the number of words: at each place where one of the words' first characters
    stands, a window of each length that words have is joined to the words, which go to the texts where they are at most
    SENT_WORDS, so that only what is found is shuffled.
    Null and empty texts and words have no occurrences; a word that is listed twice counts once; rows of one key are
    counted together.
    """
    words = words.select(F.col(word).alias("word")).where(F.length(word) > 0).distinct()
    shape = words.agg(F.array_sort(F.collect_set(F.length("word"))).alias("lengths"), F.collect_set(F.substring("word", 1, 1)).alias("first"), F.count("*").alias("n")).first()
    if not shape.lengths:
        return rows.where("false").select(key, F.lit("").alias("word"), F.lit(0).cast("long").alias("n"))
    # overlapping stretches of a text, in one pass: what follows costs the same wherever in a long text it is
    stretches = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{STRETCH - 1 + shape.lengths[-1]}}})).{{1,{STRETCH}}}"), F.lit(1))
    held = F.col("stretch")
    places = F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length(held)))
    if len(shape.first) <= FIRST_CHARACTERS:
        places = F.filter(places, lambda i: F.contains(F.lit("".join(shape.first)), F.substr(held, i, F.lit(1))))
    at = rows.where(F.length(text) > 0).select(key, F.explode(stretches).alias("stretch")).select(key, "stretch", F.explode(places).alias("at"))
    # a window that passes the end is cut there; only the whole ones may be words
    windows = at.select(key, F.explode(F.filter(F.array(*[F.struct(F.substr(held, F.col("at"), F.lit(n)).alias("word"), F.lit(n).alias("n")) for n in shape.lengths]), lambda w: F.length(w["word"]) == w["n"])).alias("w")).select(key, "w.word")
    return windows.join(F.broadcast(words) if shape.n <= SENT_WORDS else words, "word").groupBy(key, "word").agg(F.count("*").alias("n"))



def best_label(rows: DataFrame, labels: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, label) of every row: the label of ``labels`` (label, word, order) whose words occur most often in the text, of
    equals the one with the least order, null if none occurs. Keys must be distinct."""
    listed = labels.select("label", "order", "word").distinct()
    found = find_words(rows, labels, key=key, text=text).join(F.broadcast(listed) if listed.count() <= SENT_WORDS else listed, "word")
    scored = found.groupBy(key, "label").agg(F.sum("n").alias("n"), F.min("order").alias("order"))
    best = scored.groupBy(key).agg(F.max_by("label", F.struct("n", -F.col("order"))).alias("label"))
    return rows.select(key).join(best, key, "left")


def with_any(rows: DataFrame, words: DataFrame, name: str, *, key: str = "id", text: str = "text") -> DataFrame:
    """``rows`` with ``name``: whether the text holds one of the words."""
    held = find_words(rows, words, key=key, text=text).select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(held, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
