"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, blocks, durable, fields, free, trimmed

#: Most words that a task keeps the ids of.
KNOWN_WORDS = 300_000

#: Bytes of text that a task encodes at once, and of rows that Spark hands to Python at once.
BLOCK_BYTES, BATCH_BYTES = 1 << 20, 2 << 20

#: What tokens end with that end a word.
MARK = "</w>"

#: Letters that the normaliser leaves letters, each by itself: neither the dotted capital i nor what NFC changes is among them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ʯΆΈ-ΊΌΎ-ΡΣ-ϵϷ-ϿЀ-ҁҊ-ӿ\u05d0-\u05ea\u0621-\u063a\u0641-\u064aḀ-ỿぁ-ゖァ-ヺ一-鿿\uac00-\ud7a3"

#: What is a pre-token of its own after letters: ASCII punctuation without the apostrophe.
_MARKS = "".join(x for x in string.punctuation if x != "'")


def _joined(strings: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), " ")[0].as_py()


def _parted(words: pa.Array) -> pa.Array:
    """Two strings for each word: letters and the marks after them, or else the word and nothing."""
    words = words.cast(pa.string())
    stems = pc.ascii_rtrim(words, characters=_MARKS)
    offsets = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1]
    lettered = pc.match_substring_regex(stems, rf"^\p{{L}}*[{_LETTERS}]$")
    cuts = np.empty(2 * len(words) + 1, "<i4")
    cuts[::2] = offsets
    cuts[1::2] = offsets[:-1] + pc.binary_length(pc.if_else(lettered, stems, words)).to_numpy()
    return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), words.buffers()[2] or pa.py_buffer(b""))


def _gather(flat: np.ndarray, cuts: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of places in the pieces flat[cuts[i]:cuts[i + 1]]: their pieces in order, and where each list's begin."""
    lengths = np.diff(cuts)[places]
    ends = np.cumsum(lengths)
    out = flat[np.repeat(cuts[places] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return out, np.concatenate([[0], ends])[offsets - offsets[0]]


#: What WordEncoder needs of a tokenizer file (fixed values): how its texts are normalised and cut into pre-tokens.
_NORMALISED = ["NFC", {"Regex": r"\s+"}, "Lowercase"]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(spec: dict) -> bool:
    """Whether the ids of a text are those of its words, as WordEncoder takes them."""
    steps = [x.get("pattern") or x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].isascii() and " " not in t["content"] and not t["content"][:1].isalpha() for t in spec["added_tokens"])
    return steps == _NORMALISED and [x["pattern"] for x in cuts] == [{"Regex": _CUT}] and spec["model"].get("end_of_word_suffix") == MARK and plain


class WordEncoder:
    """Token ids of whole texts, as the tokenizer gives them without special tokens around; each distinct word is encoded once.

    For vocabularies whose pre-tokens never reach over white space or from letters into other characters, whose
    normaliser looks at no neighbour across white space and whose words end in a marked token, as those with word
    ends. Then the ids of a text are those of its words in order, those of letters with marks after them are the
    letters' and the marks', and words of letters that the normaliser leaves letters are pre-tokens as they are: they
    need no more of it than lower case, and can be encoded many at once, for each ends with its first marked token.
    Strings of added tokens stand inside words and become their ids there, as in whole texts. A tokenizer of another
    make encodes whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(spec)
        self.added = "|".join(re.escape(t["content"].lower()) for t in spec["added_tokens"]) or r"[^\s\S]"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(MARK)]] = True
        # two lighter ways for letters: small ASCII ones are their own bytes, others need lower case and bytes
        self.small, self.letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.small.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the ids of word i are flat[cuts[i]:cuts[i + 1]]; met: in how many blocks it was
        self.known: dict[str, int] = {}
        self.flat, self.cuts, self.met = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Only words that were met again stay, KNOWN_WORDS // 2 of them at most."""
        kept, words = np.flatnonzero(self.met > 1), list(self.known)
        kept = kept[: KNOWN_WORDS // 2]
        self.known = dict(zip(map(words.__getitem__, kept.tolist()), range(len(kept))))
        self.flat, self.cuts = _gather(self.flat, self.cuts, kept, np.arange(len(kept) + 1))
        self.met = np.ones(len(kept), np.int64)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """The numbers that new words now have."""
        small = pc.match_substring_regex(new, "^[a-z]+$").to_numpy(zero_copy_only=False)
        lettered = pc.match_substring_regex(new, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False) & ~small
        flat, lengths, at = [self.flat], [np.diff(self.cuts)], np.empty(len(new), np.int64)
        for tokenizer, those in ((self.small, small), (self.letters, lettered), (None, ~(small | lettered))):
            places = np.flatnonzero(those)
            for i in range(0, len(places), 2048):
                some = places[i : i + 2048]
                text = _joined(new.take(pa.array(some)))
                words = text.split(" ")
                at[some] = np.arange(len(self.known), len(self.known) + len(words))
                self.known.update(zip(words, at[some].tolist()))
                if tokenizer:
                    ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                    sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                if not tokenizer or len(sizes) != len(words) or sizes.sum() != len(ids):
                    ids, sizes = self._one_by_one(words)
                flat.append(ids)
                lengths.append(sizes)
        self.flat, self.cuts = np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin and the last one's end; null is empty."""
        if not self.by_words:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        low = pc.ascii_lower(coded.dictionary)  # but for what would become an added token's string
        parts = _parted(pc.if_else(pc.and_not(pc.string_is_ascii(low), pc.match_substring_regex(low, self.added)), low, coded.dictionary)).dictionary_encode()
        distinct = _joined(parts.dictionary).split(" ")
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(parts.dictionary))
        new = np.flatnonzero(at < 0)
        at[new] = self._learn(parts.dictionary.take(pa.array(new)))
        self.met[at] += 1
        flat, cuts = _gather(self.flat, self.cuts, at[parts.indices.to_numpy()], 2 * np.arange(len(coded.dictionary) + 1))
        return _gather(flat, cuts, coded.indices.to_numpy(), words.offsets.to_numpy())


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Every document's token ids and ``end_id``, cut into pieces of ``capacity`` tokens; only the last may be shorter.

    Returns one row a piece: id_col, piece (from 0), start (ids before it), length, ids_crc32 and, with ``keep_ids``,
    ids (array<int>). A null or empty text is the end id alone; repeated rows and ids stay apart; other columns go.
    """
    kept = [f for f in fields(docs) if f.name == id_col]
    schema = T.StructType([*kept, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids])

    def cut(batches):
        encode, end, step = WordEncoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for _, part in blocks(batches, text_col, BLOCK_BYTES):
            part = part.combine_chunks()
            rows, piece, start, length, crc, bits = [], [], [], [], [], []
            flat, cuts = encode(part[text_col].combine_chunks())
            for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                own = flat[a:b].tobytes() + end
                for k in range(0, len(own), step):
                    bit = own[k : k + step]
                    rows.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(bit) // 4)
                    crc.append(zlib.crc32(bit))
                    if keep_ids:
                        bits.append(bit)
            columns = {id_col: part[id_col].take(pa.array(rows)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.frombuffer(b"".join(bits), "<i4")))
            yield from pa.table(list(columns.values()), names=schema.names).to_batches()

    return docs.select(id_col, text_col).mapInArrow(trimmed(cut), schema)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``, by best-two-fit.

    A bin is filled greedily, each time with the largest item that fits; then its smallest item gives way to the two
    unpacked items of the largest sum that fit its expanded gap, if they fill it better than it did.
    """
    stacks = defaultdict(list)
    for i, n in enumerate(lengths):
        stacks[n].append(i)
    sizes = sorted(stacks)

    def take(n: int) -> int:
        i = stacks[n].pop()
        if not stacks[n]:
            del sizes[bisect_left(sizes, n)]
        return i

    def give(n: int, i: int) -> None:
        if not stacks[n]:
            sizes.insert(bisect_left(sizes, n), n)
        stacks[n].append(i)

    bins = []
    while sizes:
        own, gap, last = [], capacity, 0
        while (k := bisect_right(sizes, gap) - 1) >= 0:
            last = sizes[k]
            own.append(take(last))
            gap -= last
        if gap and sizes:
            room, best = gap + last, (last, 0, 0)
            lo, hi = 0, bisect_right(sizes, room) - 1
            while lo <= hi:
                a, b = sizes[lo], sizes[hi]
                if a + b > room:
                    hi -= 1
                    continue
                if a + b > best[0] and (lo < hi or len(stacks[a]) > 1):
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                lo += 1
            if best[0] > last:
                out = own.pop()
                own += [take(best[2]), take(best[1])]
                give(last, out)
        bins.append(own)
    return bins


def pack(pieces: DataFrame, *, length_col: str = "length", capacity: int = 4096, group_pieces: int = 1 << 15, group_tokens: int = 1 << 23) -> DataFrame:
    """``pieces`` with sequence_id and offset: every row has a place in a sequence of at most ``capacity``, without gaps.

    The rows are dealt evenly into groups of about ``group_pieces`` rows and ``group_tokens`` at most, each packed by
    best_two_fit on its own; a group leaves at most about one part-filled sequence behind, so the loss doesn't grow with the data, while no task holds
    more than a group. Rows are dealt by their place, so equal rows or ids don't meet. A null length counts as 0; one
    over ``capacity`` is an error. Columns of ``pieces`` named sequence_id or offset are replaced.
    """
    with batches_of(pieces.sparkSession, BATCH_BYTES):
        pieces = durable(pieces.drop("sequence_id", "offset"))
    rows, tokens = pieces.agg(F.count("*"), F.sum(F.col(length_col).cast("long"))).first()
    groups = max(1, -(-rows // group_pieces), -(-(tokens or 0) // group_tokens))
    (group,) = free(pieces, "group")
    schema = T.StructType([*fields(pieces), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(table: pa.Table) -> pa.Table:
        lengths = [x or 0 for x in table[length_col].to_pylist()]
        if lengths and max(lengths) > capacity:
            raise ValueError(f"a piece of {max(lengths)} doesn't fit {capacity}")
        first = table[group][0].as_py() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, own in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
        return table.drop_columns([group]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn(group, F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy(group).applyInArrow(place, schema)
