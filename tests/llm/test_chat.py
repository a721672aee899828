"""Chat formatting: what is read back is what was written, whatever the texts hold."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kawara.llm import chat

BITS = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "\\", "<|", "|>", "assistant", "user\n", "é🙂", " ", "", "<|im_end|", "%0A", "%25", "|"]


def fold(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("piece", F.lit("x"))
    out = chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("trained")).collect()
    want = fold(rows)
    assert len(out) == len(want)
    for r in out:
        turns = want[r.conv_id]
        assert [tuple(t) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.trained == "".join(t for role, t in turns if role == "assistant")
        assert len(re.findall(r"<\|im_end\|>", r.formatted)) == len(turns)
        assert all(s.start <= s.end <= len(r.formatted) for s in r.loss_spans)


def test_edges(spark):
    check(spark, [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (2, None, None, "x"), (2, 0, "assistant", "<|im_end|>"), (None, 3, "a\nb|%", "y"), (None, 3, "a\nb|%", "y"), (3, 0, "assistant", "long " * 50_000)])


def test_no_rows(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_clean_texts_stand_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <| b \\ |>")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "<|im_start|>user\na <| b \\ |><|im_end|>\n"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "sys\ntem|"]), st.lists(st.sampled_from(BITS), max_size=6).map("".join)), min_size=1, max_size=40))
def test_any_texts(spark, rows):
    check(spark, rows)
