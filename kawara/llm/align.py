"""Token alignment between two tokenizers over a whole corpus: each distinct segment is tokenised and aligned once."""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import blocks, box, fields, free, pack_ints, partitions, settled, to_arrow, unboxed, unpack_ints

#: Whatever any of the two may take for white space: the property of Unicode and four separators of ASCII.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = "\u2581"


class Tokenizers:
    """The two tokenizers, the bytes of their tokens, and where texts may be cut for both."""

    def __init__(self, byte_bpe_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(byte_bpe_path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not all(t["special"] for t in told["added_tokens"]):
            raise ValueError("the first tokenizer is byte-level BPE that splits before white space and changes no text")
        self.a = Tokenizer.from_file(byte_bpe_path)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = {i: bytes(byte[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.a_sizes, self.b_sizes = sizes, np.array([len(x) for x in self.b_bytes], np.int64)
        self.lone_space = self.b.piece_to_id(_SPACE)
        self.cuts = cut_characters(p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        if " " not in self.cuts:
            raise ValueError("the second tokenizer merges across the beginning of white space")

    def segments(self):
        """A function from a text to its segments: white space and what follows, cut only where neither can merge."""
        others = re.sub("[" + re.escape("".join(self.cuts)) + "]", "", _WHITE)
        return re.compile(f"(?:[{_WHITE}]+[^{_WHITE}]*|[^{_WHITE}]+)(?:[{others}][{_WHITE}]*[^{_WHITE}]*)*").findall

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for segments that begin with white space, none added before them."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)  # it puts a space before each
        return a, [[self.lone_space] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(segments, b)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (chr(256 + k) for k in range(256))
    return [chr(b) if b in seen else next(hidden) for b in range(256)]


def cut_characters(pieces) -> list[str]:
    """White space of ASCII that no piece holds after a character that isn't white, nor (but for the space) after a
    space: before a run that begins with it no merge can cross, as every token that does would hold both sides."""
    held = set()
    for p in pieces:
        p = p.replace(_SPACE, " ")
        for before, c in zip(p, p[1:]):
            if not re.match(f"[{_WHITE}]", before) or (c != " " and before == " "):
                held.add(c)
    return [c for c in " \t\n\x0b\x0c\r" if c not in held]


class Aligned:
    """Segments' tokens and how they line up, flat: sizes (A tokens, B tokens, links) a segment, ids of A, ids of B, and
    a step for each link, whether the tokens of both end there (BOTH) or only that of A or of B.

    A link is a stretch of bytes between neighbouring ends, so links are as many as ends, and the ids of one follow from
    the steps before it. A segment whose tokens don't spell it has none.
    """

    def __init__(self, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, steps: np.ndarray):
        self.sizes, self.a, self.b, self.steps = sizes, a, b, steps

    @classmethod
    def of(cls, tokenizers: Tokenizers, segments: list[bytes]) -> Aligned:
        sizes, a_ids, b_ids = np.zeros((3, len(segments)), np.int64), [], []
        for at in range(0, len(segments), 5000):
            part = segments[at : at + 5000]
            for k, (segment, a, b) in enumerate(zip(part, *tokenizers.encode([s.decode() for s in part])), at):
                if b"".join(map(tokenizers.a_bytes.__getitem__, a)) == segment == b"".join(map(tokenizers.b_bytes.__getitem__, b)):
                    sizes[0, k], sizes[1, k] = len(a), len(b)
                    a_ids += a
                    b_ids += b
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
        ends = np.union1d(a_ends, b_ends)
        in_a, in_b = (np.isin(ends, x, assume_unique=True) for x in (a_ends, b_ends))
        last = np.concatenate([[0], np.searchsorted(ends, a_ends, "right")])[np.cumsum(sizes[0])]  # links up to each segment's end
        sizes[2] = np.diff(last, prepend=0)
        return cls(sizes, a, b, np.where(in_a & in_b, BOTH, np.where(in_a, ONLY_A, ONLY_B)).astype(np.uint8))

    def take(self, of: np.ndarray) -> Aligned:
        """The segments ``of``, in that order."""
        flat = []
        for values, n in zip((self.a, self.b, self.steps), self.sizes):
            starts = np.cumsum(n) - n
            flat.append(values[np.repeat(starts[of], n[of]) + _within(n[of])])
        return Aligned(self.sizes[:, of], *flat)

    def links(self) -> np.ndarray:
        """Pairs of ids, a << 32 | b."""
        place = lambda other: np.cumsum(self.steps != other) - (self.steps != other)
        return self.a[place(ONLY_B)] << 32 | self.b[place(ONLY_A)]

    def groups(self) -> np.ndarray:
        """The number of groups of each segment: of ends that both share."""
        return np.diff(np.concatenate([[0], np.cumsum(self.steps == BOTH)])[np.cumsum(self.sizes[2])], prepend=0)

    def written(self, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
        """All segments' groups as text, each group followed by a semicolon, and where each segment's text begins; ``ids``
        is ``written_ids``."""
        third = len(ids) // 3
        group = np.cumsum(self.steps == BOTH) - (self.steps == BOTH)
        by_a, by_b = self.steps != ONLY_B, self.steps != ONLY_A  # where a token of each ends
        order = np.argsort(np.concatenate([2 * group[by_a], 2 * group[by_b] + 1]), kind="stable")
        shown = np.concatenate([self.a + third * (self.steps[by_a] == BOTH), self.b + 2 * third * (self.steps[by_b] == BOTH)])
        got = ids.take(pa.array(shown[order]))
        offsets = np.frombuffer(got.buffers()[1], "<i8", len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
        return memoryview(got.buffers()[2] or b"") if len(got) else memoryview(b""), offsets[np.concatenate([[0], np.cumsum(self.sizes[0] + self.sizes[1])])]


#: Which tokens end where a link does.
BOTH, ONLY_A, ONLY_B = 0, 1, 2


def written_ids(n: int) -> pa.Array:
    """The ids 0 to n - 1 with what follows them in a group's text: more of their side, the other side, the next group."""
    return pa.array([f"{i}{end}" for end in ",|;" for i in range(n)], pa.large_string())


class _Places(dict):
    """The number of a segment in order of first occurrence."""

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


def align(docs: DataFrame, byte_bpe_path: str, piece_path: str, *, text_col: str = "text", block_bytes: int = 4 << 20, range_bytes: int = 8 << 20, row_segments: int = 64) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups in place of the text column.

    A is byte-level BPE of a space and the text, B is BPE of pieces with byte fallback, which puts the space itself.
    groups lists the ids between common ends as ``a1,a2|b1;a3|b2``; a link is a pair of tokens that share a byte; its
    count is the number of documents that hold its pair of ids linked; n_best counts links whose count is the highest
    of their A id, count_sum adds up the counts of all links. A text that is null or empty, or whose tokens of either
    don't spell it, has no tokens: zeros and empty groups. Both leave a text's bytes as they are but for characters
    that one can't show, which makes the bytes fewer, so a text is spelt if each of its segments is.

    1. Texts are cut before white space where no token of either crosses (``cut_characters``); a block of about
       ``block_bytes`` keeps each text as places in its list of distinct segments.
    2. Distinct segments travel packed, a row a block for each range of their hashes; a range tokenises and aligns each
       once. The rows of both steps share one exchange.
    3. Alignments go back to their blocks, which name each pair of ids with the number of their documents that hold
       it; Spark adds the numbers up. A pair has a row a block at most, so none is hot; the highest of an A id is
       broadcast, a row for each id of A's vocabulary at most.
    4. Blocks receive alignments and counts, and put documents together.

    ``docs`` that aren't just read from files are written first (``settled``), so that a task that runs again deals the
    same blocks. Ranges are dealt to several tasks by block where they are many (``row_segments``). Repeated rows count as
    documents of their own; columns of the result's names are replaced. No rows, no rows.
    """
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    docs = settled(docs.drop(*results, "groups"))
    own, (count,) = fields(docs, (text_col,)), free(docs, "count")
    after = T.StructType([*own, *[T.StructField(x, T.LongType()) for x in results], T.StructField("groups", T.StringType())])
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).cast("long")).first()[0] or 0
    groups = max(8, -(-size // range_bytes))
    ranges = min(groups, max(8, block_bytes // 16 // row_segments))  # a block has about a distinct segment for 16 bytes
    split_by_block = -(-groups // ranges)
    made: list[Tokenizers] = []  # once a task

    def tokenizers() -> Tokenizers:
        if not made:
            made.append(Tokenizers(byte_bpe_path, piece_path))
        return made[0]

    names = ["key", "range", "rows", "places", "words"]

    def split(batches):
        import zstandard

        find, squeeze = tokenizers().segments(), zstandard.ZstdCompressor(level=3).compress
        for number, table in blocks(batches, text_col, block_bytes):
            places = _Places()
            each = [np.fromiter(map(places.__getitem__, found), np.uint32, len(found)) for found in (find(" " + t) if t else [] for t in table[text_col].to_pylist())]
            flat = np.concatenate(each)
            order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")  # frequent first: small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            listed = list(places)
            listed = [listed[i].encode() for i in order]
            of = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed)) % np.uint32(ranges)
            rest = table.drop_columns([text_col]).append_column(count, pa.array(list(map(len, each)), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.array([box(rest)], pa.binary()), pa.array([pack_ints(rank[flat])], pa.binary()), pa.array([pack_ints(of)], pa.binary())], names)
            by = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[by].astype(np.int64), prepend=-1, append=-1)) if len(by) else np.zeros(1, np.int64)
            found = [[listed[i] for i in by[a:b]] for a, b in zip(cuts, cuts[1:])]
            used = of[by][cuts[:-1]].astype(np.int64)
            lengths = [pack_ints(np.fromiter(map(len, x), np.uint32, len(x))) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(-1 - (used * split_by_block + number % split_by_block)), pa.array(used), pa.array([number.to_bytes(8, "little")] * len(used), pa.binary()), pa.array(lengths, pa.binary()), pa.array([squeeze(b"".join(x)) for x in found], pa.binary())], names)

    coded_schema = "key long, range long, sizes binary, a binary, b binary, steps binary, pair long, n long, best boolean"
    coded_names = [x.split()[0] for x in coded_schema.split(", ")]

    def align_range(table: pa.Table) -> pa.Table:
        import zstandard

        out = []
        if table["key"][0].as_py() < 0:
            squeeze, places, asked = zstandard.ZstdCompressor(level=3).compress, _Places(), []
            for lengths, words in zip(table["places"].to_pylist(), table["words"].to_pylist()):
                ends = np.cumsum(unpack_ints(lengths), dtype=np.int64).tolist()
                flat = zstandard.ZstdDecompressor().decompress(words)
                asked.append(np.array([places[flat[a:e]] for a, e in zip([0, *ends], ends)], np.int64))
            known = Aligned.of(tokenizers(), list(places))
            for number, block, of in zip(table["range"].to_pylist(), table["rows"].to_pylist(), asked):
                got = known.take(of)
                out.append((int.from_bytes(block, "little"), number, pack_ints(got.sizes.reshape(-1)), pack_ints(got.a), pack_ints(got.b), squeeze(got.steps.tobytes())))
        columns = list(zip(*out)) or [()] * 6
        arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 4))]
        return pa.table([*arrays, pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.bool_())], coded_names)

    def block_of(row: dict, right: pa.Table) -> tuple[np.ndarray, Aligned]:
        """A block's places, and its distinct segments as they were aligned."""
        import zstandard

        places, of = unpack_ints(row["places"]), unpack_ints(row["words"])
        by = np.argsort(of, kind="stable")
        starts, order, parts = np.searchsorted(of[by], right["range"].to_numpy()), [np.zeros(0, np.int64)], []
        for start, sizes, a, b, steps in zip(starts, *(right[c].to_pylist() for c in ("sizes", "a", "b", "steps"))):
            parts.append((unpack_ints(sizes).reshape(3, -1).astype(np.int64), unpack_ints(a).astype(np.int64), unpack_ints(b).astype(np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(steps), np.uint8)))
            order.append(by[start : start + parts[-1][0].shape[1]])
        order = np.concatenate(order)
        if len(order) != len(of):
            raise ValueError("segments came back without their alignment")
        none = (np.zeros((3, 0), np.int64), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint8))
        got = Aligned(*(np.concatenate(x, axis=-1) for x in zip(none, *parts)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return places, got.take(back)

    def of_documents(row: dict, places: np.ndarray, got: Aligned) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The documents, the cuts of places between them, and which have tokens."""
        table = unboxed(row["rows"])
        cuts = np.concatenate([[0], np.cumsum(table[count].to_numpy())])
        wrong = np.concatenate([[0], np.cumsum(got.sizes[0][places] == 0)])
        return table, cuts, (np.diff(cuts) > 0) & (np.diff(wrong[cuts]) == 0)

    def count_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and left["key"][0].as_py() >= 0:
            row = left.to_pylist()[0]
            places, got = block_of(row, right)
            _, cuts, spelt = of_documents(row, places, got)
            keep = np.repeat(spelt, np.diff(cuts))
            document = np.repeat(np.arange(len(spelt)), np.diff(cuts))[keep]
            document, segment = np.divmod(pd.unique(document * max(1, got.sizes.shape[1]) + places[keep]), max(1, got.sizes.shape[1]))  # a segment once a document
            number, pairs = pd.factorize(got.links())
            n = got.sizes[2]
            at = np.repeat((np.cumsum(n) - n)[segment], n[segment]) + _within(n[segment])
            held = pd.unique(np.repeat(document, n[segment]) * max(1, len(pairs)) + number[at])
            times = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
            out = [pa.table([pa.array(np.full(np.count_nonzero(times), row["key"])), pa.array(pairs[times > 0]), pa.array(times[times > 0].astype(np.int64))], ["key", "pair", "n"])]
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, ["key", "pair", "n"])

    shown: list[pa.Array] = []  # once a task

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left["key"][0].as_py() < 0:
            return to_arrow(after).empty_table()
        row, counted = left.to_pylist()[0], right.filter(right["pair"].is_valid())
        places, got = block_of(row, right.filter(right["range"].is_valid()))
        table, cuts, spelt = of_documents(row, places, got)
        pairs, n, best = (counted[c].to_numpy() for c in ("pair", "n", "best"))
        links = got.links()
        of = pd.Index(pairs).get_indexer(links)
        of, known = np.maximum(of, 0), of >= 0  # a pair that only texts without tokens hold has no count
        per_link = [np.where(known, x[of], 0) if len(x) else np.zeros(len(links), np.int64) for x in (best.astype(np.int64), n)]
        ends = np.cumsum(got.sizes[2])
        added = [np.concatenate([[0], np.cumsum(x)]) for x in per_link]
        by_segment = [got.sizes[0], got.sizes[1], got.groups(), got.sizes[2], *[x[ends] - x[ends - got.sizes[2]] for x in added]]
        table = table.drop_columns([count])
        for name, values in zip(results, by_segment):
            total = np.concatenate([[0], np.cumsum(values[places])])[cuts]
            table = table.append_column(name, pa.array(np.where(spelt, np.diff(total), 0)))
        if not shown:
            shown.append(written_ids(max(len(tokenizers().a_sizes), len(tokenizers().b_sizes))))
        text, begins = got.written(shown[0])
        said = _cut(text, begins)
        texts = [b"".join(said[places[a:b]])[:-1] if x else b"" for a, b, x in zip(cuts, cuts[1:], spelt)]
        return table.append_column("groups", pa.array(texts, pa.binary()).cast(pa.string()))

    n = partitions(docs, size, range_bytes)
    pieces = docs.mapInArrow(split, "key long, range long, rows binary, places binary, words binary").repartition(n, "key")
    coded = pieces.groupBy("key").applyInArrow(align_range, coded_schema).repartition(n, "key")
    met = pieces.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(count_pairs, "key long, pair long, n long").repartition(n, "pair")
    counted = met.withColumn("n", F.sum("n").over(Window.partitionBy("pair"))).withColumn("id_a", F.shiftright("pair", 32))
    # at most a row for each id of A; with the key, lest a narrower copy of the exchange be made for it
    highest = counted.groupBy("id_a").agg(F.max(F.struct("n", "key")).alias("top")).select("id_a", F.col("top.n").alias("highest"))
    back = counted.join(F.broadcast(highest), "id_a").select("key", F.lit(None).cast("long").alias("range"), *[F.lit(None).cast("binary").alias(x) for x in ("sizes", "a", "b", "steps")], "pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    return pieces.groupBy("key").cogroup(coded.unionByName(back).groupBy("key")).applyInArrow(put_together, after)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _cut(values, bounds: np.ndarray) -> np.ndarray:
    """``values`` in pieces between neighbouring bounds, as an array of objects."""
    out, bounds = np.empty(len(bounds) - 1, object), bounds.tolist()
    out[:] = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    return out
