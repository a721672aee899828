"""The pipeline's near-copy stage against brute force: five-word shingles, 0.8 or more in common."""

import random

from test_pipeline import alike, components, shingles
from test_text_operators import plain_fingerprint

import corpus_pipeline
from kawara.llm import jaccard


def variants(seed):
    """Texts of several lengths, and chains of copies with more and more words changed."""
    rng, rows = random.Random(seed), [(500, None), (501, ""), (502, " "), (503, "a b c"), (504, "A b  c"), (None, "a b c d"), (None, "lone text"), (503, "other text of the same id")]
    for n in (1, 4, 5, 6, 9, 14, 40, 120, 400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(14):
            rows.append((len(rows), " ".join(words)))
            for k in rng.sample(range(n), rng.choice((0, 1, 1, 1 + n // 60)) if n > 1 else 0):
                words[k] = f"w{rng.randrange(10**6)}"
    return rows + rows[10:20]


def test_components(spark):
    rows = variants(1)
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(components(rows), key=str)
    assert jaccard.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_component():
    rng = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.015 else w for w in base) for _ in range(300)]
    hashes = jaccard._Hashes()
    label = jaccard._alike([jaccard._shingles(t.encode(), 5, hashes) for t in texts])
    assert label.tolist() == [i for _, i in components(list(enumerate(texts)))]


def test_chunks_and_rounds(spark):
    """A large group of near copies of one text, chains out of it and texts that share a passage, in chunks of a few nodes."""
    rng = random.Random(4)
    base, passage = [f"w{k}" for k in range(80)], [f"p{k}" for k in range(30)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in base)) for i in range(150)]
    rows += [(1000 + i, " ".join([f"y{i}_{k}" for k in range(12)] + passage)) for i in range(40)]
    words = list(base)
    for i in range(40):
        words[i * 2] = f"z{i}"
        rows.append((2000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds, chunk in ((0, 500), (2, 500), (2, 1 << 20)):
        got = jaccard.near_copies(df, rounds=rounds, chunk_shingles=chunk).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted(components(rows))


def test_stage_finds_copies_beyond_three_bits(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    first, second = " ".join(words), " ".join([*words[:30], "other", *words[31:70], "another", *words[71:110], "third", *words[111:]])
    assert (plain_fingerprint(first) ^ plain_fingerprint(second)).bit_count() > 3 and alike(shingles(first), shingles(second))
    docs = spark.createDataFrame([(1, first), (2, second), (3, "else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == [1, 3]


def test_fingerprints_link_first(spark, monkeypatch):
    """With a radius fingerprints propose links, checked by shingles; components stay those of the shingles alone."""
    words = [f"w{i * 7919 % 1009}" for i in range(1200)]
    texts = [" ".join(words), " ".join([*words[:600], "other", *words[601:]]), " ".join([*words[:500], *["x"] * 60, *words[560:]]), " ".join(reversed(words)), "a b", "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    grid = jaccard.grid_links
    monkeypatch.setattr(jaccard, "grid_links", lambda prints, **more: asked.append(more["radius"]) or grid(prints, **more))
    got = [sorted(map(tuple, jaccard.near_copies(docs, radius=r).collect())) for r in (None, 3)]
    assert got[0] == got[1] == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)] and asked == [3]
    one = jaccard._fingerprint(jaccard.np.array([1, 3, 1 << 63], jaccard.np.uint64))
    assert int(one) == 1
