"""Cells with very many fingerprints: those linked and those not, against neighbours looked up bit by bit."""

import time

import numpy as np
import pytest

from kawara.llm import simhash


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def neighbours(bits, radius):
    """All pairs within ``radius`` by looking up every change of up to so many bits: for radius 2 at most."""
    at, out = {int(x): i for i, x in enumerate(bits)}, []
    for x, i in at.items():
        changes = [1 << a | 1 << b for a in range(64) for b in range(a, 64)] if radius > 1 else [1 << a for a in range(64)]
        out += [(i, at[x ^ c]) for c in changes if at.get(x ^ c, -1) > i]
    return out


@pytest.mark.parametrize("kind", ["one cell", "few bits", "one block"])
def test_split_links_connect_what_all_pairs_connect(kind):
    rng = np.random.default_rng(8)
    if kind == "one cell":  # each two-bit segment has one bit: all in one cell of both halves
        bits = np.array([sum((1 + int(c)) << 2 * k for k, c in enumerate(row)) for row in rng.integers(0, 2, (3000, 32))], np.uint64)
        bits[1000:1300] = bits[:300] ^ np.uint64(3)
    elif kind == "few bits":  # all within twelve bits
        bits = rng.permutation(1 << 12)[:3000].astype(np.uint64) << np.uint64(20)
    else:
        bits = rng.integers(0, 1 << 63, 3000).astype(np.uint64) & ~np.uint64(0xFFFF_FFFF)
    bits = np.unique(bits)
    node = np.arange(len(bits))
    got = [(a, b) for x, y in simhash._split_links(bits, node, 2) for a, b in zip(x.tolist(), y.tolist())]
    assert all((int(bits[a]) ^ int(bits[b])).bit_count() <= 2 for a, b in got)
    assert components(len(bits), got) == components(len(bits), neighbours(bits, 2))


def test_time_of_unlinked_fingerprints():
    rng = np.random.default_rng(9)
    bits = np.unique(rng.integers(0, 1 << 62, 100_000).astype(np.uint64))
    began = time.process_time()
    got = list(simhash._split_links(bits, np.arange(len(bits)), 3))
    assert time.process_time() - began < 60 and sum(len(a) for a, _ in got) < 100


def test_a_crowded_cell(spark):
    rng = np.random.default_rng(10)
    bits = np.unique(np.array([sum((1 + int(c)) << 2 * k for k, c in enumerate(row)) for row in rng.integers(0, 2, (20_000, 32))], np.uint64))
    bits = np.unique(np.concatenate([bits, bits[:500] ^ np.uint64(3 << 10)]))
    df = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bits.view(np.int64).tolist())], "node long, fingerprint_bits long")
    got = [(r.a, r.b) for r in simhash.grid_links(df, hot_rows=2048).collect()]
    want = [(i, j) for i, j in neighbours(bits, 2)]
    assert components(len(bits), got) == components(len(bits), want) and len(want) >= 500
