"""The registered queries over whole tables: against SQL where they have it, else against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_text_operators import heap_loads, plain_fingerprint
from test_vectors_and_warc import brute
from tokenizers import Tokenizer

from kawara.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda names, found: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found), key=repr)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096 and len(held) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_byte_bpe(spark, texts):
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = {i: whole.encode_ordinary(t) for i, t in texts.items()}
    got = sorted(tuple(r) for r in queries.op3_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == sorted((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(texts[i])) for i, x in ids.items())


def test_simhash(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    group, changed = {i: i for i in prints}, True
    while changed:
        new = {i: min(group[j] for j, y in prints.items() if (x ^ y).bit_count() <= 3) for i, x in prints.items()}
        changed, group = new != group, new
    got = sorted(tuple(r) for r in queries.op5_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted((i, f"{x:016x}", group[i]) for i, x in prints.items())


def test_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    got = sorted(tuple(r) for r in queries.op8_nearest_vectors(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted((q, k + 1, i, s) for q, x in want.items() for k, (i, s) in enumerate(x))


def test_secrets(spark, texts):
    patterns = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": 6, "access": 20, "hex": 24}
    want = {}
    for i, t in texts.items():
        found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t, re.I | re.A if k == "assign" else 0) if len(m[2] if k == "assign" else m[0]) >= least[k]]
        counts = Counter(k for _, _, k, _ in found)
        want[i] = (*(counts[k] for k in patterns), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))))
    rows = queries.op9_secret_scan(spark, SF).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == want
    assert all(sha(",".join(s for s in r.spans.split(",") if s.split(":")[0] in patterns)) == r.base_sha256 for r in rows)


def test_shards(spark, texts):
    rows = queries.op10_lpt_shards(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} <= set(range(24))
    homes, loads, groups = {}, Counter({s: 0 for s in range(24)}), Counter()
    for r in rows:
        assert homes.setdefault(texts[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r.size
        groups[texts[r.doc_id]] += r.size
    for s in loads:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert [loads[s] for s in range(24)] == heap_loads(list(groups.values()), 24)
