"""Byte-level BPE over a whole corpus: each distinct pre-token is encoded once, wherever it occurs."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, box, fields, free, pack_ints, partitions, settled, to_arrow, unboxed, unpack_ints


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: token bytes in base 64 and the id, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def word_encoding(path: str):
    """An encoding that takes every text as one pre-token."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})


class _Places(dict):
    """The number of a pre-token in order of first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Ids(dict):
    """The ids of a pre-token, made when first asked for."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = np.array(self.encoding.encode_ordinary(word.decode()), "<u4").tobytes()
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", block_bytes: int = 4 << 20, range_bytes: int = 8 << 20, row_words: int = 64, decoded: bool = False) -> DataFrame:
    """``docs`` with token_ids (binary: little-endian unsigned 32-bit ids) in place of the text column.

    1. A task splits the texts by ``pattern`` and, for every block of about ``block_bytes``, keeps each text as places
       in the block's list of distinct pre-tokens (a frequent word leaves a block once).
    2. The distinct pre-tokens travel packed, a row a block for each range of their hashes; a range encodes each one
       once.
    3. The ids go back to their blocks, where every text is put together again by position.

    The first two steps' rows share one exchange. There is a range for about ``range_bytes`` of text, so that its
    rows fit a task, until a row holds only about ``row_words`` pre-tokens; from then on a range's rows are dealt to
    several tasks by their block, each of which encodes the range's pre-tokens once. So rows stay in proportion to the
    texts.

    Blocks are numbered by partition and arrival, so ``docs`` that aren't just read from files are written first
    (``settled``): a task that is run again meets the same rows in the same order. A null or empty text has no ids; repeated
    rows stay; a column named token_ids is replaced.

    With ``decoded`` the ids are decoded again into a column of that name: a row for each distinct id of a block joins
    the token-byte table (broadcast; a row an id of the vocabulary, whatever the corpus), and with what it says the
    block's texts are put together as bytes, too.
    """
    docs = settled(docs.drop("token_ids", *["decoded"] * decoded))
    own, (count,) = fields(docs, (text_col,)), free(docs, "count")
    after = T.StructType([*own, T.StructField("token_ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decoded])
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).cast("long")).first()[0] or 0
    groups = max(8, -(-size // range_bytes))
    ranges = min(groups, max(8, block_bytes // 32 // row_words))  # a block has about a distinct pre-token for 32 bytes
    split_by_block = -(-groups // ranges)
    names = ["key", "range", "rows", "places", "words"]

    def split(batches):
        import regex
        import zstandard

        find = regex.compile(pattern).findall
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, table in blocks(batches, text_col, block_bytes):
            places = _Places()
            each = [np.fromiter(map(places.__getitem__, found), np.uint32, len(found)) for found in (find(t or "") for t in table[text_col].to_pylist())]
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

    encoding = []  # made once a task

    def encode_range(table: pa.Table) -> pa.Table:
        import zstandard

        out = []
        if table["key"][0].as_py() < 0:
            if not encoding:
                encoding.append(word_encoding(ranks_path))
            ids = _Ids(encoding[0])
            for number, block, lengths, words in zip(table["range"].to_pylist(), table["rows"].to_pylist(), table["places"].to_pylist(), table["words"].to_pylist()):
                ends = np.cumsum(unpack_ints(lengths), dtype=np.int64).tolist()
                flat = zstandard.ZstdDecompressor().decompress(words)
                got = [ids[flat[a:e]] for a, e in zip([0, *ends], ends)]
                # ids as places in the row's own list of them, the frequent first: small numbers
                used, ids_at, times = np.unique(np.frombuffer(b"".join(got), "<u4"), return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                out.append((int.from_bytes(block, "little"), number, pack_ints(np.fromiter(map(len, got), np.uint32, len(got)) // 4), pack_ints(used[order]), pack_ints(rank[ids_at])))
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["key", "range", "lengths", "used", "ids"])

    def used_ids(table: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate([np.zeros(0, "<u4"), *map(unpack_ints, table["used"].to_pylist())])).astype(np.int64)
        each = lambda x: pa.array(np.full(len(ids), x), pa.int64())
        return pa.table({"key": each(table["key"][0].as_py()), "least": each(min(table["range"].to_pylist())), "id": pa.array(ids, pa.int64())})

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if decoded:
            named = [x for some in right["named"].to_pylist() for x in some or ()]
            used, tokens = np.array([x["id"] for x in named], np.int64), pa.array([x["bytes"] for x in named], pa.large_binary())
        if left.num_rows and left["key"][0].as_py() >= 0:
            for rows, places, of in zip(left["rows"], left["places"].to_pylist(), left["words"].to_pylist()):
                table, places, of = unboxed(rows), unpack_ints(places), unpack_ints(of)
                by = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[by], right["range"].to_numpy())
                size, offset, ids, at = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), [np.zeros(0, "<u4")], 0
                for start, n, u, b in zip(starts, *(right[c].to_pylist() for c in ("lengths", "used", "ids"))):
                    lengths = unpack_ints(n).astype(np.int64)
                    here = by[start : start + len(lengths)]
                    size[here] = lengths
                    offset[here] = at + np.cumsum(lengths) - lengths
                    ids.append(unpack_ints(u)[unpack_ints(b)])
                    at += len(ids[-1])
                if not (size > 0).all():
                    raise ValueError("pre-tokens came back without ids")
                ids, cuts = np.concatenate(ids), np.concatenate([[0], np.cumsum(table[count].to_numpy())])
                texts = []
                for a, b in zip(cuts, cuts[1:]):
                    lengths = size[places[a:b]]
                    ends = np.cumsum(lengths)
                    texts.append(ids[np.repeat(offset[places[a:b]] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
                texts = pa.array(texts, pa.binary())
                table = table.drop_columns([count]).append_column("token_ids", texts)
                if decoded:
                    table = table.append_column("decoded", pa.chunked_array([join_bytes(tokens, texts.slice(at, 200), used) for at in range(0, len(texts), 200)], pa.binary()))
                out.append(table)
        return pa.concat_tables(out) if out else to_arrow(after).empty_table()

    n = partitions(docs, size, range_bytes)
    pieces = docs.mapInArrow(split, "key long, range long, rows binary, places binary, words binary").repartition(n, "key")
    coded = pieces.groupBy("key").applyInArrow(encode_range, "key long, range long, lengths binary, used binary, ids binary")
    if decoded:
        coded = coded.repartition(n, "key")
        named = coded.groupBy("key").applyInArrow(used_ids, "key long, least long, id long").join(F.broadcast(token_table(docs.sparkSession, ranks_path)), "id")
        named = named.repartition(n, "key").groupBy(F.col("key").alias("of")).agg(F.min("least").alias("least"), F.sort_array(F.collect_list(F.struct("id", "bytes"))).alias("named"))
        # the first of a block's rows takes the block's tokens along; both sides lie by key already, so nothing is sent again
        coded = coded.join(named, (F.col("key") == F.col("of")) & (F.col("range") <= F.col("least")), "left").drop("of", "least")
    return pieces.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(put_together, after)


def token_bytes(ranks_path: str) -> pa.Array:
    """The token-byte table: each id's bytes, null for an id that no token has."""
    ranks = read_ranks(ranks_path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.large_binary())


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table: (id, bytes)."""
    return spark.createDataFrame(sorted((i, bytearray(token)) for token, i in read_ranks(ranks_path).items()), "id long, bytes binary")


def join_bytes(tokens: pa.Array, ids: pa.Array, of: np.ndarray | None = None) -> pa.Array:
    """The bytes of each value of ``ids``, looked up at once in the table, whose rows are the ids from 0 on, or those of
    ``of``; null stays null, an id that it lacks is an error."""
    flat = np.frombuffer(b"".join(x.as_py() or b"" for x in ids), "<u4")
    if of is not None:
        at = np.searchsorted(of, flat)
        if len(flat) and (at.max() == len(of) or (of[at] != flat).any()):
            raise ValueError("an id that the table lacks")
        flat = at
    got = tokens.take(pa.array(flat)) if not len(flat) or flat.max() < len(tokens) else None
    if got is None or got.null_count:
        raise ValueError("an id that the table lacks")
    offsets = np.frombuffer(got.buffers()[1], "<i8", len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
    counts = np.asarray(pc.fill_null(pc.binary_length(ids), 0)) // 4
    cuts = offsets[np.concatenate([[0], np.cumsum(counts)])]
    data = memoryview(got.buffers()[2]) if len(got) else memoryview(b"")
    return pa.array([None if not v else bytes(data[a:b]) for v, a, b in zip(ids.is_valid().to_pylist(), cuts, cuts[1:])], pa.binary())


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with decoded (binary): the bytes of its ids, by a join to the token-byte table.

    The table has a row for each id of the vocabulary, whatever the corpus, so every task holds it (a broadcast join),
    and the ids of a batch are looked up at once: a join of Spark's would need a row for each token and a shuffle to
    put the texts together again. Null ids have null bytes, no ids have none, an id that the table lacks is an error; a
    column named decoded is replaced.
    """
    encoded = encoded.drop("decoded")
    schema = T.StructType([*fields(encoded), T.StructField("decoded", T.BinaryType())])

    def join(batches):
        tokens = token_bytes(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, join_bytes(tokens, part.column(ids_col))], schema.names)

    return encoded.mapInArrow(join, schema)
