"""Secret scans: patterns, and candidates that are decoded and confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, trimmed

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "private_key", "signed_token")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:(?!-----).)+)-----END \1PRIVATE KEY-----", re.DOTALL)
#: White space as escapes of JSON or an env file, once or more often escaped.
_ESCAPED = re.compile(r"\\+[nrt]")
_HEADERS = re.compile(r"\s*(?:[A-Za-z0-9-]+:[^\n]*\n(?:[^\S\n]+[^\n]*\n)*)+")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED")
#: Consecutive lines of base 64, maybe indented.
_LINES = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\n))[A-Za-z0-9+/_-]{16,}(?:(?:[^\S\n\r]*\r?\n[^\S\n\r]*|(?:\\+r)?\\+n)[A-Za-z0-9+/_-]+)+={0,2}")
_BREAK = re.compile(r"[^\S\n\r]*\r?\n[^\S\n\r]*|(?:\\+r)?\\+n")
_PACKED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Where a key may begin inside a run, after a path or a word that is glued to it: a DER sequence or OpenSSH's magic.
_BEGINS = re.compile(r"(?<=[/_+-])(?:MI[A-Za-z0-9+/_-]|MC|MD|ME|MF|MG|MH|b3BlbnNzaC1rZXkt)")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]{16,})")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")

#: A private key has up to ten elements on a level (PKCS#1 of several primes); more are none.
MOST_ELEMENTS = 16
_ONE_ALPHABET = str.maketrans("-_", "+/")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and where the content of the DER element at ``at`` begins and ends; None if it passes ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[start:end] exactly; None if they don't, or are more than a key ever has on one level."""
    out = []
    while start < end:
        if len(out) == MOST_ELEMENTS or (x := _element(data, start, end)) is None:
            return None
        out.append(x)
        start = x[2]
    return out


def _openssh_size(data: bytes) -> int | None:
    """How long the OpenSSH key is that ``data`` begins with, by the lengths of its parts; None if it doesn't hold one."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, parts, keys = len(magic), 3, 0  # cipher, key derivation and its options
    while parts:
        if at + 4 > len(data):
            return None
        at, parts = at + 4 + int.from_bytes(data[at : at + 4], "big"), parts - 1
        if not parts and not keys:
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 0 < keys < 16:
                return None
            parts = keys + 1  # the public keys and the private part
    return at if at <= len(data) else None


def is_private_key(data: bytes) -> bool:
    """A DER private key (PKCS#1, DSA, PKCS#8, SEC 1, or an encrypted PKCS#8) or an OpenSSH one, with lengths that nest exactly."""
    if (size := _openssh_size(data)) is not None:
        return size == len(data)
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _children(data, top[1], top[2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02:
        version = data[inner[0][1] : inner[0][2]]
        if version in (b"\0", b"\1") and len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True  # PKCS#1: version and eight numbers
        if version == b"\0" and tags == [0x02] * 6:
            return True  # DSA: version and five numbers
        if version in (b"\0", b"\1") and len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
            kind = _children(data, *inner[1][1:])
            return bool(kind) and kind[0][0] == 0x06  # PKCS#8: version, algorithm, key
        return version == b"\1" and tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1
    if tags == [0x30, 0x04]:
        kind = _children(data, *inner[0][1:])
        return bool(kind) and [t for t, _, _ in kind] == [0x06, 0x30]  # encrypted PKCS#8
    return False


def _unpacked(text: str) -> bytes | None:
    """Base 64, of either alphabet, without white space; None if it isn't."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(text: str) -> dict | None:
    try:
        got = json.loads(_unpacked(text) or b"")
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


class _View:
    """``size`` bytes that base 64 from ``start`` on stands for, each decoded only where it is looked at: whether lengths
    nest is known from the heads of a few elements, however long the text that they claim."""

    def __init__(self, text: str, start: int, size: int):
        self.text, self.start, self.size = text, start, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        a, b, _ = at.indices(self.size) if isinstance(at, slice) else (at, at + 1, 1)
        if a >= b:
            return b""
        part = self.text[self.start + a // 3 * 4 : self.start + -(-b // 3) * 4]
        got = base64.b64decode(part + "=" * (-len(part) % 4))[a % 3 : a % 3 + b - a]
        return got if isinstance(at, slice) else got[0]

    def startswith(self, head: bytes) -> bool:
        return self[: len(head)] == head


def _wrapped(lines: re.Match) -> list[tuple[int, int]]:
    """Spans of private keys that are two or more lines, all of one width but for the last, which is no longer.

    Lines of one width are joined once, however many of them a key may begin at.
    """
    at, text = lines.start(), lines[0]
    cuts = [(0, 0), *(m.span() for m in _BREAK.finditer(text)), (len(text), len(text))]
    each = [(a, b) for (_, a), (b, _) in zip(cuts, cuts[1:])]
    out, i, first, last, same, joined = [], 0, 0, -1, 0, ""
    while i < len(each):
        width = each[i][1] - each[i][0]
        if i > last or width != same:  # the last line of a stretch may begin the next
            first, last, same = i, i, width
            while last + 1 < len(each) and each[last][1] - each[last][0] == width >= len(text[slice(*each[last + 1])].rstrip("=")):
                last += 1
            joined = "".join(text[a:b] for a, b in each[first : last + 1]).rstrip("=").translate(_ONE_ALPHABET)
        start, ends = (i - first) * width, []
        if width >= 16 and text.startswith(("M", "b3BlbnNzaC1rZXkt"), each[i][0]):  # a sequence, or OpenSSH's magic
            if joined[start] == "b":
                ends = [(last, len(joined)), (last - 1, (last - first) * width)]
            elif top := _element(_View(joined, start, min(12, (len(joined) - start) * 3 // 4)), 0, 1 << 40):
                used = -(-top[2] * 4 // 3)  # its length says how many lines
                ends = [(i - (-used // width) - 1, min(start + used, len(joined)))]
        for end, stop in ends:
            if i < end <= last and (stop - start) % 4 != 1 and is_private_key(_View(joined, start, (stop - start) * 3 // 4)):
                # what is left of the last line is padding
                if stop == len(joined) if end == last else stop == (end + 1 - first) * width:
                    out.append((at + each[i][0], at + each[end][1]))
                    i = end
                    break
        i += 1
    return out


def _key_in(run: str) -> tuple[int, int] | None:
    """Where a private key stands in a run of base 64: the whole run, or what follows one of its marks, as far as its length says."""
    if (data := _unpacked(run)) and is_private_key(data):
        return 0, len(run)
    text = run.rstrip("=").translate(_ONE_ALPHABET)
    for start in (0, *(m.start() for m in _BEGINS.finditer(run))):
        room = (len(text) - start) * 3 // 4
        if run.startswith("b3Blbn", start):
            size = _openssh_size(_View(text, start, room))
        else:
            head = _View(text, start, min(12, room))[:]
            top = _element(head, 0, 1 << 40) if head and head[0] == 0x30 else None
            size = top[2] if top and 30 <= top[2] <= room and is_private_key(_View(text, start, top[2])) else None
        if size:
            end = start + -(-size * 4 // 3)
            return start, end + (min(-(end - start) % 4, len(run) - len(text)) if end == len(text) else 0)
    return None


class _Inside:
    """Whether a place is in one of some spans; places are asked for from left to right."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.next, self.end = sorted(spans), 0, -1

    def __contains__(self, place: int) -> bool:
        while self.next < len(self.spans) and self.spans[self.next][0] <= place:
            self.end = max(self.end, self.spans[self.next][1])
            self.next += 1
        return place < self.end


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed in KINDS."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    pems = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = _ESCAPED.sub("\n", m[2])
            head = _HEADERS.match(body)
            data = _unpacked(re.sub(r"\s+", "", body[head.end() :] if head else body))
            if data and (is_private_key(data) or head and _ENCRYPTED.search(head[0])):
                pems.append(m.span())
    known = _Inside(pems)
    pems = pems + [x for m in _LINES.finditer(text) if m.start() not in known for x in _wrapped(m)]
    keys, known = list(pems), _Inside(pems)
    for m in _PACKED.finditer(text):
        if m.start() not in known and (found_at := _key_in(m[0])):
            keys.append((m.start() + found_at[0], m.start() + found_at[1]))
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            keys.append(m.span())
    found += [("private_key", *x) for x in sorted(set(keys))]
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            head = _json_object(m[1])
            if head and isinstance(head.get("alg"), str) and _json_object(m[2]) is not None:
                found.append(("signed_token", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets, array<struct<kind, start, end>> in code points of the whole text, end exclusive.

    assign, access and hex are patterns alone. private_key and signed_token are reported only after a base-64 or hex
    candidate, which may be wrapped in lines, or a PEM body decodes to a key encoding whose nested lengths fit to the byte, or to a signed-token
    header that names its algorithm; a PEM body with headers that call it encrypted needs only decode. Spans of different kinds may overlap. A null text is empty and has none; repeated
    rows stay; a column named secrets is replaced.
    """
    docs = docs.drop("secrets")
    schema = T.StructType([*fields(docs), T.StructField("secrets", SPANS)])

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t or "")] for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def _masked(text: str, spans: list[dict], mark: str) -> str:
    pieces, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start > at or not pieces:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", spans_col: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span; spans that overlap or touch make one. Null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t if t is None or not s else _masked(t, s, mark) for t, s in zip(batch.column(text_col).to_pylist(), batch.column(spans_col).to_pylist())]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(trimmed(run), T.StructType(fields(docs)))
