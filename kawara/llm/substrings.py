"""Removal of passages that occur more than once in a corpus."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, fields, pack_ints, pack_longs, partitions, to_arrow, trimmed, unboxed, unpack_ints, unpack_longs, utf8

#: Bases of the rolling hashes, odd numbers, modulo 2**64.
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Hashes(dict):
    """64-bit hashes of words, made when first asked for; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def window_hashes(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of ``width`` word hashes: h(i+1) = h(i) * B - w(i) * B**width + w(i+width).

    The recurrence is unrolled by doubling: a window of 2k words is one of k words times B**k plus the next k words.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, done, have, block, base, rest = np.zeros(n, np.uint64), 0, words, 1, base, width
        while rest:
            if rest & 1:
                total = total * np.uint64(base) + have[done : done + n]
                done += block
            rest >>= 1
            if rest:
                have = have[: len(have) - block] * np.uint64(base) + have[block:]
                base = base * base & (2**64 - 1)
                block *= 2
    return total


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits depend on all bits, for even buckets."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))


def _block_hashes(texts: list[bytes], width: int, hashes: _Hashes, hash_bits: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, two hashes (64 and 24 bits) of every window of every text in order, and how many windows each text has."""
    split = [t.split() for t in texts]  # bytes split at exactly the six ASCII white characters
    counts = np.fromiter(map(len, split), np.int64, len(split))
    windows = np.maximum(counts - width + 1, 0)
    own = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
    inside = np.ones(max(0, len(own) - width + 1), bool)  # not those that reach from one text into the next
    for end in (np.cumsum(counts)[:-1] if len(counts) else ()):
        inside[max(0, end - width + 1) : end] = False
    first = _mixed(window_hashes(own, width)[inside])
    second = (_mixed(window_hashes(own, width, SECOND_BASE)[inside]) >> np.uint64(40)).astype(np.uint32)
    return split, first & np.uint64((2**64 - 1) ^ (2 ** (64 - hash_bits) - 1)), second, windows


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of hashes, in order; each window's pair; how often each pair occurs."""
    order = np.argsort(first)
    one, other = first[order], second[order]
    if ((one[1:] == one[:-1]) & (other[1:] != other[:-1])).any():
        order = np.lexsort((second, first))
        one, other = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return one[new], other[new], of, np.diff(np.append(np.flatnonzero(new), len(order)))


def _packed_places(block: np.ndarray, at: np.ndarray):
    """(block, ats packed) a block."""
    order = np.lexsort((at, block))
    block, at = block[order], at[order]
    cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1)) if len(block) else np.zeros(1, np.int64)
    blobs = [pack_ints(at[a:b]) for a, b in zip(cuts, cuts[1:])]
    yield from pa.table({"block": block[cuts[:-1]], "ats": pa.array(blobs, pa.binary())}).to_batches(max_chunksize=10_000)


def _unpacked(batch: pa.RecordBatch):
    """The pairs of each row, (first, second, block, at)."""
    for block, start, a, b in zip(batch.column("block").to_pylist(), batch.column("start").to_pylist(), batch.column("first"), batch.column("second")):
        first, second = np.cumsum(unpack_longs(a.as_py()), dtype=np.uint64).view(np.int64), np.zeros((len(b.as_py()) // 3, 4), np.uint8)
        second[:, :3] = np.frombuffer(b.as_py(), np.uint8).reshape(-1, 3)
        yield first, second.view("<i4").reshape(-1), np.full(len(first), block), np.arange(start, start + len(first), dtype=np.int32)


def _twice_by_range(batches):
    """Of rows of sent_windows, sorted by range, the places of pairs that stand twice; a range at a time in memory."""

    def counted(held):
        first, second, block, at = (np.concatenate(x) for x in zip(*held))
        _, _, of, times = _distinct(first.view(np.uint64), second.view(np.uint32))
        hit = (times > 1)[of]
        yield from _packed_places(block[hit], at[hit])

    now, held = None, []
    for batch in batches:
        for number, row in zip(batch.column("range").to_pylist(), _unpacked(batch)):
            if number != now and held:
                yield from counted(held)
                held = []
            now = number
            held.append(row)
    if held:
        yield from counted(held)


def _spread(batches):
    """The pairs of rows of sent_windows, a row each."""
    names = ["first", "second", "block", "at"]
    for batch in batches:
        held, n = [], 0
        for row in _unpacked(batch):
            held.append(row)
            n += len(row[0])
            if n > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)


def _twice(batches, slack: int = 1 << 20):
    """Of (first, second, block, at), sorted by the hashes, the places of those that stand twice: (block, ats packed)."""

    carried, carried_hit, found, n = None, False, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if carried is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(carried, columns)]
        same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
        hit = np.zeros(len(columns[0]), bool)
        hit[1:] |= same
        hit[:-1] |= same
        hit[0] |= carried_hit
        carried, carried_hit = [x[-1:] for x in columns], bool(hit[-1])  # what follows may equal it
        hit[-1] = False
        found.append((columns[2][hit], columns[3][hit]))
        n += len(found[-1][0])
        if n > slack:
            yield from _packed_places(*(np.concatenate(x) for x in zip(*found)))
            found, n = [], 0
    if carried_hit:
        found.append((carried[2], carried[3]))
    if sum(len(x) for x, _ in found):
        yield from _packed_places(*(np.concatenate(x) for x in zip(*found)))


def sent_windows(boxes: DataFrame, text_col: str, width: int, ranges: int, hash_bits: int = 64) -> DataFrame:
    """What blocks send: a row for each range that they have windows in, (range, block, start, first, second)."""

    def send(batches):
        hashes = _Hashes()
        edges = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
        for batch in batches:
            for number, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
                _, first, second, _ = _block_hashes(utf8(unboxed(rows)[text_col]), width, hashes, hash_bits)
                first, second, _, _ = _distinct(first, second)
                cuts = np.concatenate([[0], np.searchsorted(first >> np.uint64(32), edges), [len(first)]])
                used = np.flatnonzero(np.diff(cuts))
                blobs = [pack_longs(np.diff(first[a:b], prepend=np.uint64(0))) for a, b in zip(cuts[used], cuts[used + 1])]
                checks = [second[a:b].view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for a, b in zip(cuts[used], cuts[used + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), number)), pa.array(cuts[used]), pa.array(blobs, pa.binary()), pa.array(checks, pa.binary())], ["range", "block", "start", "first", "second"])

    return boxes.select("block", "rows").mapInArrow(trimmed(send), "range long, block long, start long, first binary, second binary")


def n_ranges(size: int, blocks: int, range_bytes: int, row_pairs: int) -> tuple[int, bool]:
    """How many ranges: one for each ``range_bytes`` of text, but so few that a block's rows hold ``row_pairs`` or more on average; and whether that makes ranges larger."""
    wanted, most = max(1, -(-size // range_bytes)), max(1, size // max(1, blocks) // 8 // row_pairs)  # a word has about 8 bytes or more
    return min(wanted, most), wanted > most


def remove_repeats(docs: DataFrame, *, text_col: str = "text", width: int = 35, block_bytes: int = 3 << 20, range_bytes: int = 8 << 20, row_pairs: int = 16, hash_bits: int = 64) -> DataFrame:
    """``docs`` with kept_text, n_words, n_removed and removed, array<struct<start, end>>: maximal intervals of words.

    A window is ``width`` consecutive words of one text, as they stand. A word goes if it lies in a window whose words
    also start at another place, in this text or another; all windows are judged on the texts as given.

    1. Texts are written in blocks of about ``block_bytes``. A block takes two Rabin-Karp hashes of every
       window, both over the same 64-bit hashes of its words, knows itself which pairs it holds twice, and sends each distinct pair once.
    2. Pairs travel packed, a row for each range of the first hash, which Spark deals and sorts; a partition counts
       one range after the other and sends back the places of pairs that stand twice.
    3. The places meet the blocks again; windows found twice merge into intervals.

    Ranges grow in number with the corpus, one for about ``range_bytes`` of text. Beyond so many that a block's rows
    would hold fewer than ``row_pairs`` pairs, a range no longer has to fit in memory: its pairs become rows that Spark
    sorts, spilling where it must. So rows sent stay in proportion to the texts. A passage copied a million times is one pair a
    block. Windows count as equal if both hashes, 64 and 24 bits, are: n windows have about n*n/2**89 false pairs, 0.2
    for 1e13, beside those of different words of one 64-bit hash, which agree in both: V words have about V*V/2**65
    such pairs, 0.03 for 1e9. ``hash_bits`` keeps only so many bits of the first. A null text has no words and its kept_text
    is null; an empty one stays empty; kept words are joined by one space. Repeated rows count as texts of their own;
    columns named like the results are replaced.
    """
    results = ("kept_text", "n_words", "n_removed", "removed")
    docs = docs.drop(*[c for c in results if c != text_col])
    own = fields(docs)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    after = T.StructType([*own, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans)])
    boxes = boxed(docs, text_col, block_bytes)
    size, n_blocks = boxes.agg(F.sum("size"), F.count("*")).first()
    ranges, large = n_ranges(size or 0, n_blocks, range_bytes, row_pairs)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = None
        out = []
        for rows in left["rows"]:
            table = unboxed(rows)
            split, first, second, counts = _block_hashes(utf8(table[text_col]), width, _Hashes(), hash_bits)
            _, _, of, times = _distinct(first, second)
            repeated = times > 1
            for ats in right["ats"].to_pylist():
                repeated[unpack_ints(ats)] = True
            hit, ends = repeated[of], np.cumsum(counts)
            kept, n_words, n_removed, removed = [], [], [], []
            for ws, end, windows in zip(split, ends.tolist(), counts.tolist()):
                here = np.flatnonzero(hit[end - windows : end])
                n_words.append(len(ws))
                if not len(here):
                    kept.append(b" ".join(ws))
                    n_removed.append(0)
                    removed.append([])
                    continue
                gaps = np.flatnonzero(np.diff(here) > width)  # windows that touch or overlap make one interval
                starts, stops = here[np.concatenate([[0], gaps + 1])].tolist(), (here[np.concatenate([gaps, [len(here) - 1]])] + width).tolist()
                kept.append(b" ".join([w for a, b in zip([0, *stops], [*starts, len(ws)]) for w in ws[a:b]]))
                n_removed.append(sum(stops) - sum(starts))
                removed.append([{"start": a, "end": b} for a, b in zip(starts, stops)])
            texts = pa.array([k if v else None for k, v in zip(kept, table[text_col].is_valid().to_pylist())], pa.binary()).cast(pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for name, column in zip(results, (texts, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind)), strict=True):
                table = table.append_column(name, column)
            schema = table.schema
            out.append(table)
        return pa.concat_tables(out) if out else (schema or to_arrow(after)).empty_table()

    sent = sent_windows(boxes, text_col, width, ranges, hash_bits)
    sent = sent.repartition(max(ranges, partitions(docs, 0, 1)), "range")
    if large:
        flat = sent.mapInArrow(_spread, "first long, second int, block long, at int")
        twice = flat.sortWithinPartitions("first", "second").mapInArrow(trimmed(_twice), "block long, ats binary")
    else:
        twice = sent.sortWithinPartitions("range").mapInArrow(trimmed(_twice_by_range), "block long, ats binary")
    return boxes.select("block", "rows").groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(remove, after)
