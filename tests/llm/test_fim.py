"""Fill-in-middle against a plain version by a pattern, and the automaton against a walk byte by byte."""

import hashlib
import random
import re

import numpy as np
import pytest

from kawara.llm import fim

ODD = [
    None, "", " ", "\t\n", "a", " a", "a ", " a b ", "one two  three\n\nfour", "né́ 日本 語 🙂 x", "a<P>b", "<M>", "<S", "<<P> <", "< P>", "<P <S", "x <", "\x85   y", "lone\x00zero", "word " * 4000, "日" * 3000, "a b", "a b",
]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_equals_pattern(spark, block_bytes):
    rows = [(100 * k + n, t, "kept") for k in range(6) for n, t in enumerate(ODD)] + [(None, "null key is no digits", "kept"), (7, "same", "kept"), (7, "same", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumnRenamed("form", "N_")
    out = fim.transform(docs, block_bytes=block_bytes).withColumn("again", fim.restored()).collect()
    assert len(out) == len(rows) and {r.N_ for r in out} == {"kept"}
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out), key=key) == sorted(((k, *plain(k, t), t or "") for k, t, _ in rows), key=key)
    assert {r.form for r in out} == {"plain", "spm", "psm"}


def test_no_rows(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scan_is_the_walk():
    scanner, rng = fim.Scanner(("<P>", "<S>", "<M>")), random.Random(3)
    for _ in range(50):
        data = np.array([rng.choice(b"<<>PSM \nab\xff\xe6\x97\xa5") for _ in range(500)], np.uint8)
        state, want = 0, []
        for c in scanner.classes[data]:
            want.append(scanner.emits[state * scanner.n_classes + c])
            state = int(scanner.next[state * scanner.n_classes + c])
        for piece in (1, 7, 1 << 20):
            assert scanner.scan(data, piece).tolist() == want


def test_sentinels_that_cannot_be_read_back():
    for bad in (("<P>", ">x", "<M>"), ("< P", "<S>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Scanner(bad)
