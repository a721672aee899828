"""Fill-in-middle: texts cut between units into prefix, middle and suffix, written in sentinel order and read back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fields, utf8

#: What a transition emits: the first byte of a code point, the first byte of a unit, the last byte of a sentinel.
CHAR, UNIT, MARK = 1, 2, 4
#: Ends a text; no byte of UTF-8 has this value.
END = 0xFF
_WHITE = b" \t\n\x0b\x0c\r"


class Scanner:
    """A byte automaton as two tables, next state and what the step emits, by state and class of byte.

    A state is where a unit stands (nothing yet, in its leading white space, in its word) and the longest beginning of
    a sentinel that the bytes so far end with. A unit is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`, or the white space
    that ends a text. The state follows from the last ``reach`` bytes alone, so a block of bytes is scanned at once:
    every position folds the bytes before it through the table, from the state that nothing leads to.
    """

    def __init__(self, sentinels: tuple[str, ...]):
        marks = [s.encode() for s in sentinels]
        if any(not m or set(m) & set(_WHITE) or max(m) > 0x7F for m in marks):
            raise ValueError("a sentinel is ASCII without white space")
        if any(b.startswith(a[-k:]) and not (a == b and k == len(a)) for a in marks for b in marks for k in range(1, len(a) + 1)):
            raise ValueError("a sentinel begins with the end of another, so that what is written can't be read back")
        self.reach = max(map(len, marks))
        heads = sorted({m[:k] for m in marks for k in range(len(m))})  # a whole sentinel is followed like nothing at all
        letters = sorted({x for m in marks for x in m})
        white, inner, lead, end = (len(letters) + k for k in range(4))
        self.classes = np.full(256, lead, np.uint8)
        self.classes[list(_WHITE)] = white
        self.classes[0x80:0xC0] = inner
        self.classes[END] = end
        self.classes[letters] = range(len(letters))
        n = self.n_classes = end + 1
        self.next, self.emits = np.zeros(3 * len(heads) * n, np.uint8), np.zeros(3 * len(heads) * n, np.uint8)
        for unit in range(3):
            for h, head in enumerate(heads):
                for c in range(end):
                    got = head + (bytes([letters[c]]) if c < len(letters) else b"\0")
                    longest = next(k for k in range(len(got) + 1) if got[k:] in heads)
                    to = 1 if c == white else 2
                    at = (unit * len(heads) + h) * n + c
                    self.next[at] = to * len(heads) + heads.index(got[longest:])
                    self.emits[at] = CHAR * (c != inner) + UNIT * (unit == 0 or (unit, to) == (2, 1)) + MARK * (got in marks)

    def scan(self, data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """What each byte of ``data`` emits; the state before the first is that of an ended text."""
        out = np.empty(len(data), np.uint8)
        for at in range(0, len(data), piece):
            before = min(at, self.reach)
            part = self.classes[data[at - before : at + piece]]
            classes = np.concatenate([np.full(self.reach - before, self.n_classes - 1, np.uint8), part])
            n = len(classes) - self.reach
            state = np.zeros(n, np.intp)
            for k in range(self.reach):
                state = self.next[state * self.n_classes + classes[k : k + n]].astype(np.intp)
            out[at : at + n] = self.emits[state * self.n_classes + classes[self.reach :]]
        return out


def draws(seed: int, key: object) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that follow from the seed and the row's key; a null key counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(
    docs: DataFrame,
    *,
    text_col: str = "text",
    key_col: str = "doc_id",
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars and output.

    One scan of a block's bytes counts each text's units, code points and sentinels; a second pass over the unit starts
    finds the bytes where prefix and middle end. Where, and whether, follows from ``seed`` and ``key_col``. A text that
    is null or empty (null counts as empty) or holds a sentinel stays plain, with null prefix_chars and middle_chars.
    psm is prefix, suffix, middle, each after its sentinel, spm suffix, prefix, middle. No shuffle; a task holds a block
    of texts, or one longer text. Repeated rows stay and come out alike; columns of the result's names are replaced.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    schema = T.StructType([*fields(docs), *[T.StructField(x, T.StringType() if x in ("form", "output") else T.LongType()) for x in names]])
    scanner = Scanner(sentinels)
    first, second, third = (s.encode() for s in sentinels)

    def one(text: bytes, key, n: int, marked: bool, units: np.ndarray, emits: np.ndarray) -> tuple:
        one_cut, other, chance, order = draws(seed, key)
        if not text or marked or chance % 100 >= percent:
            return n, "plain", None, None, text
        cuts = sorted((one_cut % (n + 1), other % (n + 1)))
        a, b = (int(units[k]) if k < n else len(text) for k in cuts)
        chars = [int(np.count_nonzero(emits[x:y] & CHAR)) for x, y in ((0, a), (a, b))]
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if order % 100 < spm_percent:
            return n, "spm", *chars, b"".join((second, suffix, first, prefix, third, middle))
        return n, "psm", *chars, b"".join((first, prefix, second, suffix, third, middle))

    def run(batches):
        for _, table in blocks(batches, text_col, block_bytes):
            texts = utf8(table[text_col])
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            starts = np.cumsum(lengths) - lengths
            emits = scanner.scan(np.frombuffer(b"".join(x for t in texts for x in (t, bytes([END]))), np.uint8))
            units = np.flatnonzero(emits & UNIT)
            marked = np.add.reduceat((emits & MARK).astype(bool), starts, dtype=np.int64) > 0
            first_unit = np.searchsorted(units, [*starts, len(emits)])
            out = [one(t, k, int(v - u), m, units[u:v] - s, emits[s : s + len(t)]) for t, k, m, s, u, v in zip(texts, table[key_col].to_pylist(), marked.tolist(), starts.tolist(), first_unit, first_unit[1:])]
            columns = [pa.array(x, pa.binary() if k == 4 else pa.string() if k == 1 else pa.int64()) for k, x in enumerate(zip(*out))]
            columns[4] = columns[4].cast(pa.string())
            for k, x in enumerate(columns):
                table = table.append_column(names[k], x)
            yield from table.to_batches()

    return docs.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")):
    """The text that ``output`` was made from, by its form: a Column. Null stays null."""
    piece = lambda k: F.get(F.split(F.col(output), "|".join(f"\\Q{s}\\E" for s in sentinels)), F.lit(k))
    return F.when(F.col(form) == "psm", F.concat(piece(1), piece(3), piece(2))).when(F.col(form) == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(F.col(output))
