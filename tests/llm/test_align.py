"""Token alignment against whole texts tokenised and aligned one by one."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kawara.llm import align, queries
from kawara.llm.common import settled

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain(texts: list[str | None]) -> list[tuple]:
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: n for n, c in enumerate(align._byte_letters())}
    each = []
    for text in texts:
        got = []
        if text:
            ids, other = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in other]
            if b"".join(t for _, t in x) == (" " + text).encode() == b"".join(t for _, t in y):
                got = [x, y]
        each.append(got)
    spans = lambda tokens: [(i, sum(len(t) for _, t in tokens[:k]), sum(len(t) for _, t in tokens[: k + 1])) for k, (i, _) in enumerate(tokens)]
    linked, grouped, counts = [], [], Counter()
    for got in each:
        x, y = (spans(g) for g in got) if got else ([], [])
        links = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e]
        ends = sorted({e for *_, e in x} & {f for *_, f in y})
        listed = lambda tokens, s, e: ",".join(str(i) for i, u, v in tokens if s <= u and v <= e)
        grouped.append(";".join(f"{listed(x, s, e)}|{listed(y, s, e)}" for s, e in zip([0, *ends], ends)))
        linked.append((len(x), len(y), len(ends), links))
        counts.update(set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(x, y, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), said) for (x, y, g, links), said in zip(linked, grouped)]


ODD = [
    None, "", " ", "  ", "\n", "\t\r\n \n", "a", " a", "a ", "a  b   c    ", "x\r\ny\rz; \r\n)", "it's  we'll 'tis", "né́e naïve Straße", "日本語のテキスト、空白 なし", "🙂🙂 🙂", "a b  c　d",
    "a▁b", "<s> </s> <unk> <0x0A> <|endoftext|>", "a\x00b \x1c \x1f x\x85y", "﻿a  \U0010ffff", "word" * 3000, " " * 5000 + "end", "same text", "same text", "1234567 89 , . ;;  z",
]


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_equals_whole_texts(spark, tmp_path, block_bytes):
    spark.createDataFrame([(k, t, "kept") for k, t in enumerate(ODD)], "id long, text string, n_a string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).withColumn("count", F.col("id"))
    rows = align.align(docs, A, B, block_bytes=block_bytes, row_segments=1, range_bytes=1 << 10).orderBy("id").collect()
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in rows] == plain(ODD)
    assert [r["count"] for r in rows] == list(range(len(ODD)))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, text string")
    out = align.align(empty, A, B)
    assert out.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"] and out.count() == 0


def test_cut_characters():
    assert align.cut_characters(["▁a", "▁▁", "b"]) == [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    assert align.cut_characters([";\r", "a▁b", "▁\t"]) == ["\n", "\x0b", "\x0c"]


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").orderBy("doc_id").collect()
    whole = {r.doc_id: r for r in queries.op11_token_alignment(spark, SF).collect()}
    assert len(whole) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r, want in zip(docs, plain([r.text for r in docs])):
        got = whole[r.doc_id]
        assert (got.n_a, got.n_b, got.n_groups, got.n_links) == want[:4]
        assert got.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")


def test_rows_that_a_shuffle_deals_are_written_first(spark, tmp_path):
    spark.createDataFrame([(k, "a b " * k) for k in range(20)], "id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert settled(docs) is docs and settled(narrow := docs.where("id > 3").select("text")) is narrow
    for dealt in (docs.repartition(3), docs.join(docs.select("id"), "id"), docs.distinct(), docs.orderBy("id")):
        copy = settled(dealt)
        assert copy is not dealt and copy.count() == dealt.count() and settled(copy) is copy
    assert align.align(docs.repartition(3), A, B).count() == 20
