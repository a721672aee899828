"""Near-duplicates by SimHash fingerprints, joined on a grid of per-segment bit counts."""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, durable, fields, utf8

#: Cells of up to so many rows are compared row by row at once; larger ones by a search that leaves a spanning forest.
SMALL_CELL = 16
#: Fingerprints that are compared with each other without looking at blocks of their bits first.
LARGE_GROUP = 512


def _fingerprints(texts: list[bytes], shingle_words: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    out, each, counts, first = np.zeros(len(texts), np.uint64), [], [], 0

    def close(last: int) -> None:
        if not counts:
            return
        flat, n = np.concatenate(each), np.array(counts)
        starts, full = np.cumsum(n) - n, np.flatnonzero(n)
        votes = np.zeros((len(n), 64), np.int64)
        if len(full):
            bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
        out[first:last] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)

    held = 0
    for i, text in enumerate(texts):
        ws = text.lower().split()  # of bytes: A-Z only, and the six ASCII white characters
        if len(ws) > shingle_words:
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*(islice(ws, k, None) for k in range(shingle_words)))), repeat(42)), np.uint64, len(ws) - shingle_words + 1)
        else:
            hashes = np.array([digest(b" ".join(ws), 42)] if ws else [], np.uint64)
        each.append(hashes)
        counts.append(len(hashes))
        held += len(hashes)
        if held > 50_000:
            close(i + 1)
            each, counts, first, held = [], [], i + 1, 0
    close(len(texts))
    return out


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``docs`` without the text column, with fingerprint_bits (long): the SimHash of its word shingles.

    A-Z is lower-cased; shingles are ``shingle_words`` words joined by spaces, repeats included (fewer words: all of
    them); each votes with the bits of its XXH64 (seed 42), and a bit is 1 if more than half have it. No words, or
    null: zero. Repeated rows stay; a column of the result's name is replaced.
    """
    docs = docs.drop("fingerprint_bits")
    schema = T.StructType([*fields(docs, (text_col,)), T.StructField("fingerprint_bits", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints = pa.array(_fingerprints(utf8(part.column(text_col)), shingle_words).view(np.int64))
                rest = [part.column(f.name) for f in part.schema if f.name != text_col]
                yield pa.RecordBatch.from_arrays([*rest, prints], schema.names)

    return docs.mapInArrow(run, schema)


def _split_links(bits: np.ndarray, node: np.ndarray, radius: int, splits: int = 4):
    """Links that connect what the links of ``radius`` bits connect.

    The bits in which the fingerprints differ are cut into ``radius`` + 1 blocks: two that are linked agree in one of
    them, so each block's groups of equal ones are gone through by themselves, cut again while they are large. So
    unlinked fingerprints meet few others, however many share a cell.
    """
    if len(bits) > LARGE_GROUP and splits:
        varying = int(np.bitwise_or.reduce(bits ^ bits[0]))
        places = [k for k in range(64) if varying >> k & 1]
        for b in range(radius + 1):
            mask = np.uint64(sum(1 << k for k in places[b :: radius + 1]))
            order = np.argsort(bits & mask, kind="stable")
            cuts = np.flatnonzero(np.diff((bits & mask)[order]))
            for group in np.split(order, cuts + 1):
                if len(group) > 1:
                    yield from _split_links(bits[group], node[group], radius, splits - 1)
        return
    todo = np.arange(len(bits))
    while len(todo):
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            here = frontier.pop()
            near = np.bitwise_count(bits[todo] ^ bits[here]) <= radius
            found, todo = todo[near], todo[~near]
            if len(found):
                yield np.full(len(found), node[here]), node[found]
                frontier += found.tolist()


def _cell_links(cell: np.ndarray, up: np.ndarray, bits: np.ndarray, node: np.ndarray, radius: int):
    """Links of nodes that share a cell, rows sorted by cell; of a large cell, a spanning forest of its links."""
    starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    sizes = np.diff(np.append(starts, len(cell)))
    has_base = np.logical_or.reduceat(~up, starts)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL) & has_base, sizes)
    cell, left, right = np.where(small, cell, -1 - np.arange(len(cell))), [], []
    for d in range(1, SMALL_CELL):
        i = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= radius]
        left.append(node[i])
        right.append(node[i + d])
    for s, n in zip(starts[(sizes > SMALL_CELL) & has_base].tolist(), sizes[(sizes > SMALL_CELL) & has_base].tolist()):
        for a, b in _split_links(bits[s : s + n], node[s : s + n], radius):
            left.append(a)
            right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def grid_links(prints: DataFrame, *, bits_col: str = "fingerprint_bits", node_col: str = "node", radius: int = 3, hot_rows: int = 2048) -> DataFrame:
    """Links (a, b) between nodes whose 64-bit fingerprints differ in at most ``radius`` (up to 3) bits.

    A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings
    is at most the Hamming distance; split over two halves of 16 counts, one half is at distance 0 or 1. So each
    fingerprint stands in one grid cell for each half, and also looks into the cells one count higher along each of
    the 16 axes; nodes that meet are verified on all 64 bits.

    Cells of more than ``hot_rows`` rows are split: two fingerprints that meet by a half in which they differ in one
    bit at most agree in one of its two 16-bit parts, and in one of the four 8-bit parts of the other half, so each
    row goes to eight smaller cells, one for each choice of the two. ``prints`` has distinct fingerprints. All links
    between small cells' nodes come out; where many nodes share a cell, enough of the links to connect what they
    connect. No rows, no links.
    """
    if radius > 3:
        raise ValueError("two halves find at most three differing bits")
    x = F.col(bits_col)
    low = F.lit(0xFFFFFFFF)

    def counts(half):
        return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))

    cells = prints.select(x.alias("bits"), F.col(node_col).alias("node"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("half"), counts(x.bitwiseAND(low)).alias("at")), F.struct(F.lit(1).cast("long").alias("half"), counts(F.shiftrightunsigned(x, 32)).alias("at")))).alias("c"))
    cells = cells.select("bits", "node", (F.shiftleft(F.col("c.half"), 40) + F.col("c.at")).alias("cell"))
    steps = F.expr("explode(concat(array(0L), transform(filter(sequence(0, 15), i -> (shiftrightunsigned(cell, 2 * i) & 3) < 2), i -> shiftleft(1L, 2 * i))))")
    rows = cells.select("bits", "node", "cell", steps.alias("step")).select((F.col("cell") + F.col("step")).alias("cell"), (F.col("step") > 0).alias("up"), "bits", "node")
    hot = durable(rows.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows).select(F.col("cell").alias("hot")))
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, rows["cell"] == hot["hot"], "left")
        second = F.shiftright("cell", 40) == 1  # the half that the cell is of
        own, other = (F.when(second == F.lit(top), F.shiftrightunsigned("bits", 32)).otherwise(F.col("bits").bitwiseAND(low)) for top in (True, False))
        part = lambda p, q: F.lit((4 * p + q + 1) << 24) + F.shiftleft(F.shiftright(own, 16 * p).bitwiseAND(F.lit(0xFFFF)), 8) + F.shiftright(other, 8 * q).bitwiseAND(F.lit(0xFF))
        parts = F.when(F.col("hot").isNotNull(), F.array(*[F.xxhash64("cell", part(p, q)) for p in range(2) for q in range(4)])).otherwise(F.array("cell"))
        rows = rows.select(F.explode(parts).alias("cell"), "up", "bits", "node")

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table):
            t = table.combine_chunks()
            a, b = _cell_links(t["cell"].to_numpy(), t["up"].to_numpy(zero_copy_only=False), t["bits"].to_numpy().view(np.uint64), t["node"].to_numpy(), radius)
            yield from pa.table({"a": a, "b": b}).to_batches(max_chunksize=50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut:
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """One row a document: id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Fingerprints that differ in at most ``radius`` bits are linked, those of texts without words like any other. Equal
    fingerprints are joined before the grid, so copies never pair up. A fingerprint's node is its smallest id, so a
    component's smallest node names it. Rows with a null id take part like others but name no component: one of theirs
    alone has a null component_id; their nodes lie above all ids, so an id of 2**62 or more is an error. Other columns
    go; repeated rows stay.
    """
    top = F.lit(2**62)
    prints = durable(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))))
    least = F.when(F.col("least") >= top, F.raise_error(F.lit("ids end below 2**62")).cast("long")).otherwise(F.col("least"))
    nameless = top + F.pmod(F.xxhash64("fingerprint_bits"), F.lit(2**61))
    distinct = durable(prints.groupBy("fingerprint_bits").agg(F.min("id").alias("least")).select("fingerprint_bits", F.coalesce(least, nameless).alias("node")))
    found = components(grid_links(distinct, radius=radius))
    root = F.coalesce("component", "node")
    named = distinct.join(found, "node", "left").select("fingerprint_bits", F.when(root < top, root).alias("component_id"))
    return prints.join(named, "fingerprint_bits").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")
