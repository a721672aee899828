"""Normalisation, extraction and classification of Japanese shop news, as Columns.

Nothing here keeps state or leaves the JVM: every function takes Columns and returns one, and the word lists are folded
into the expression. White space means what ECMAScript's \\s matches, which is wider than Java's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

WHITE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

_WHITE_CHARACTERS = "\t\n\x0b\x0c\r\u00a0\u1680\u2028\u2029\u202f\u205f\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_WIDE = "".join(chr(c + 0xFEE0) for r in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)) for c in r) + "\uff0d\u2015\u3000"
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE[:62]) + "-- "
#: One of the wide characters. As ranges, after a look at whether the character may be one, most take one comparison.
_ANY_WIDE = r"(?=[\u2015-\uFF5A])[\uFF10-\uFF19\uFF21-\uFF3A\uFF41-\uFF5A\uFF0D\u2015\u3000]"

#: Fixed patterns of the notation of names, addresses, phone numbers and dates.
_KANJI, _RUN = "一-龥", "一-龥ぁ-んァ-ヶー々"
#: Whether a kanji, a kana or one of their marks follows: patterns that begin with one are tried nowhere else.
_JAPANESE = "(?=[々-龥])"
_NOT_JAPANESE, _ALL_JAPANESE = "[^々-龥]+", re.compile("[々-龥]+")
_MUNICIPALITY = "市|区|町|村"
_PREF = "|".join(words.PREFS)
_LABEL = r"(?:場所は|所在地は?|住所[:：]?|Address[:：]?\s*|店舗情報[:：]?\s*)"
_TAIL = r"(?:番地?\d*)?(?:号)?"
_FULL_ADDRESS = rf"((?:{_PREF})[^\s、。]+?\d+[\d\-ー―－]*{_TAIL}[^\s、。]*)"
_CITY_ADDRESS = rf"(?<![{_RUN}])([{_KANJI}々ヶ]{{1,8}}(?:{_MUNICIPALITY})[{_RUN}]{{1,12}}(?:\d+丁目)?\d+(?:[-－−ー―‐]\d+)*{_TAIL})"
_CHOME_ADDRESS = rf"(?<![{_RUN}])([{_KANJI}々]{{1,8}}(?:{_MUNICIPALITY})[{_KANJI}々]{{1,6}}(?:\d+|[一二三四五六七八九十])丁目)"
_TEL = r"(0\d{1,4}[-−ー―]?\d{1,4}[-−ー―]?\d{3,4})"
_OPENS = r"(?:オープン|OPEN|開店|開業)"
_OPENS_TOO = r"(?:オープン|OPEN|開店|開業|グランドオープン)"
_FULL_DATE = r"(\d{4})[年/\-.](\d{1,2})[月/\-.](\d{1,2})"
_STATION = rf"(?<![{_RUN}])([{_RUN}]{{2,6}}駅)"

#: Fixed patterns and words of headlines: their beginnings, a review's phrase, endings, and what opens or closes.
_HEAD_BRACKETS, _HEAD_NUMBER = r"【[^】]*】\s*", r"^\s*\d+[.、]\s*"
_HEAD_DATE = r"(?iu)^(?:\d{4}年)?\d{1,2}月\d{1,2}日\s*(?:に|の)?\s*(?:オープン|OPEN|開店|開業|グランドオープン|新規オープン)(?:予定)?[、,\s]*"
_QUOTED = "「([^」]+)」|『([^』]+)』"
_REVIEWED = rf"{_OPENS}[、,\s]+([^、。]{{2,30}}?)(?:で(?:頂く|いただく|味わう|食べ|楽し|堪能|楽しむ)|にて)"
_HEAD_END = r"[！!？?。]*\s*\z"
_NEWS = [rf"[、。]?\s*{day}\s*{_OPENS_TOO}(?:予定)?{_HEAD_END}" for day in (r"\d{1,4}年\d{1,2}月\d{1,2}日", r"\d{1,2}月\d{1,2}日", r"\d{1,2}月")] + [
    rf"[、。]?\s*(?:に|で|へ|が|は|を)?\s*(?:新規)?{_OPENS_TOO}(?:予定|へ)?{_HEAD_END}"
]
_TALK = r"[、。]?\s*(?:注目|話題|大人気)\s*\z"
_SHOP = r"(?:専門店|食堂|レストラン|ダイニング|カフェ|酒場|バル|ビストロ|店)"
_STYLED = rf"[にへ]「[^」]{{2,}}」|[にへ][^{WHITE}、。]{{0,14}}{_SHOP}(?:が|、|を|[{WHITE}]|\z)"
_OPENING_TITLES = ["オープン", "OPEN", "開店", "開業"]
_OPENING_ARTICLES = ["オープン", "OPEN", "開店", "開業", "新規オープン", "新店"]
_OPENING_TEXTS = ["オープン", "開店", "開業", "グランドオープン", "新規開店", "新装開店"]
_CLOSING = ["閉店", "閉業", "ラストデー", "ラストオーダー終了"]
_OPENING_AGAIN = "(?i)オープン|OPEN|開店|開業|グランドオープン|新規開店|New Open|NEW OPEN"


def nonblank(col: Column) -> Column:
    """The text, or null where it is empty (as after a pattern without a match)."""
    return F.nullif(col, F.lit(""))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    return nonblank(F.regexp_extract(text, pattern, group))


def any_of(text: Column, ws: list[str]) -> Column:
    """Whether the text holds one of the words, as one alternation.

    Words are tried only at characters that begin one, or beyond ASCII lie between the first and the last that do, so a
    text in another script is gone through once.
    """
    if "" in ws or not ws:
        return text.rlike("|".join(map(re.escape, ws)))
    plain, other = ([w for w in ws if w[0].isascii() == ascii] for ascii in (True, False))
    begin = "".join(sorted({re.escape(w[0]) for w in plain}))
    bounds = f"{min(w[0] for w in other)}-{max(w[0] for w in other)}" if other else ""
    parts = [f"(?=[{at}])(?:{'|'.join(map(re.escape, part))})" for at, part in ((begin, plain), (bounds, other)) if part]
    return text.rlike(parts[0] if len(parts) == 1 else f"(?=[{begin}{bounds}])(?:{'|'.join(parts)})")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, in branches too."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends. Single spaces, which stay, are no match."""
    return F.trim(F.regexp_replace(text, f"(?! ?[!-~])(?: [{WHITE}]+|[{WHITE}&&[^ ]][{WHITE}]*)", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def normalize_text(text: Column) -> Column:
    """Full-width letters, digits, dashes and spaces narrowed, white space squeezed; null is empty. The long vowel mark stays."""
    given = F.coalesce(text, F.lit(""))
    return squeeze(F.when(given.rlike(_ANY_WIDE), F.translate(given, _WIDE, _NARROW)).otherwise(given))


def normalize_name(name: Column) -> Column:
    """A key for shop names: no brackets, company forms or spaces, lower case; may be empty."""
    return F.lower(_no_white(_company_free(_narrow(name))))


def _company_free(name: Column) -> Column:
    """Without what stands in brackets, and company forms. The patterns run on names that hold their first character alone."""
    bare = F.when(name.contains("(") | name.contains("（"), F.regexp_replace(name, r"[（(].*?[)）]", "")).otherwise(name)
    return F.when(bare.contains("会社"), F.regexp_replace(bare, "株式会社|有限会社|合同会社", "")).otherwise(bare)


def _narrow(text: Column) -> Column:
    """As normalize_text, but each white character is a space of its own: where spaces go anyway, that is one pass less."""
    return F.translate(F.coalesce(text, F.lit("")), _WIDE + _WHITE_CHARACTERS, _NARROW + " " * len(_WHITE_CHARACTERS))


def _no_white(narrow: Column) -> Column:
    """Normalised or narrowed text without its spaces, which are all the white space that it has."""
    return F.replace(narrow, F.lit(" "), F.lit(""))


def normalize_address(address: Column) -> Column:
    """A key for addresses: no spaces, all dashes alike, the long vowel mark among them."""
    return F.translate(_no_white(_narrow(address)), "‐－−ー―", "-----")


def normalize_tel(tel: Column) -> Column:
    """The digits, if there are at least nine."""
    digits = F.regexp_replace(_narrow(tel), "[^0-9]", "")
    return F.when(F.length(digits) >= 9, digits)


def extract_pref(text: Column) -> Column:
    """The first prefecture of the list that the text names, wherever it stands."""
    return F.coalesce(*[F.when(text.contains(p), p) for p in words.PREFS])


def extract_city(address: Column, pref: Column) -> Column:
    """The shortest stretch after the prefecture that ends like a municipality."""
    return F.coalesce(*[F.when(pref == p, extract(address, rf"{p}([^0-9\-{WHITE}]+?[市区町村])")) for p in words.PREFS])


def clean_address(address: Column) -> Column:
    """An address without the remarks and punctuation after it."""
    bare = F.regexp_replace(normalize_text(address), r"\s*[※（(【][\s\S]*\z", "")
    return F.trim(F.regexp_replace(bare, r"[、。\s]+\z", ""))


def extract_address(text: Column, pref: Column | None = None) -> Column:
    """The first full address; else, within ``pref``, a municipality with numbers; else one with a block number."""

    def found(plain: Column) -> Column:
        ways = [extract(plain, _JAPANESE + _FULL_ADDRESS)]
        if pref is not None:
            ways += [F.concat(nonblank(pref), extract(plain, _JAPANESE + p)) for p in (_CITY_ADDRESS, _CHOME_ADDRESS)]
        return F.coalesce(*ways)

    address = once(F.regexp_replace(normalize_text(text), f"(?=[A々-龥]){_LABEL}", ""), found)
    return once(address, lambda a: F.when(a.isNotNull(), clean_address(a)))


def extract_tel(text: Column) -> Column:
    """The first number shaped like a phone's, in the text as it stands; null if that one is too short."""
    return normalize_tel(extract(text, _TEL))


def extract_open_date(text: Column, year: Column | None = None) -> Column:
    """The opening day, yyyy-mm-dd, by the first of three notations; years far from the article's don't count.

    A day that the calendar lacks comes out as written; parsing it is up to the caller.
    """
    year = F.lit(None).cast("int") if year is None else year

    def dated(pattern: str) -> Column:
        y, m, d = (extract(text, pattern, i).cast("int") for i in (1, 2, 3))
        fits = year.isNull() | (year == 0) | y.between(year - 1, year + 2)
        return F.when(y.isNotNull() & fits, F.concat_ws("-", y.cast("string"), _two(m), _two(d)))

    short = rf"(\d{{1,2}})月(\d{{1,2}})日[{WHITE}]*(?:に?[{WHITE}]*{_OPENS})"
    m, d = (extract(text, short, i).cast("int") for i in (1, 2))
    this_year = F.when(m.isNotNull() & year.isNotNull() & (year != 0), F.concat_ws("-", year.cast("string"), _two(m), _two(d)))
    return F.coalesce(dated(rf"{_FULL_DATE}日?(?:に?[{WHITE}]*{_OPENS})"), dated(rf"(?:オープン日?[:：]?[{WHITE}]*|OPEN[:：]?[{WHITE}]*){_FULL_DATE}"), this_year)


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def count_of(text: Column, ws: list[str]) -> Column:
    """How often words that can't overlap themselves occur, in all. A lambda over the list keeps the generated code short."""
    one = lambda w: ((F.octet_length(text) - F.octet_length(F.replace(text, w, F.lit("")))) / F.octet_length(w)).cast("int")
    return F.aggregate(F.array(*[F.lit(w) for w in ws]), F.lit(0), lambda n, w: n + one(w))


def best_label(text: Column, lists: dict[str, list[str]]) -> Column:
    """The label whose words occur most often; of equals the earlier one, null if none occurs.

    Japanese words are counted in what the text has of that script, which keeps each of their occurrences.
    """

    def count(of: Column, ws: list[str]) -> Column:
        own = [w for w in ws if _ALL_JAPANESE.fullmatch(w)]
        rest = [w for w in ws if w not in own]
        return reduce(Column.__add__, [count_of(of[c], part) for c, part in (("japanese", own), ("text", rest)) if part])

    def best(of: Column) -> Column:
        scores = [F.struct(count(of, ws).alias("n"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, ws) in enumerate(lists.items())]
        return F.array_max(F.array(*scores))

    found = once(F.struct(text.alias("text"), F.regexp_replace(text, _NOT_JAPANESE, " ").alias("japanese")), best)
    return once(found, lambda best: F.when(best["n"] > 0, best["label"]))


def extract_genre(text: Column, title: Column | None = None) -> Column:
    """The first genre with a word in the title; else the one whose words are most frequent in the text."""
    scored = F.when(any_of(text, sorted({w for ws in words.GENRES.values() for w in ws})), best_label(text, words.GENRES))
    if title is None:
        return scored
    return F.coalesce(*[F.when(any_of(title, ws), label) for label, ws in words.GENRES.items()], scored)


def extract_store_name(title: Column) -> Column:
    """The shop's name in a headline: a quotation, the name in a review's phrase, or what is left without the news."""
    text = F.trim(F.regexp_replace(F.regexp_replace(normalize_text(title), _HEAD_BRACKETS, ""), _HEAD_NUMBER, ""))
    text = F.trim(F.regexp_replace(text, _HEAD_DATE, ""))

    def name(found: Column) -> Column:
        found = F.trim(found)
        return F.when((utf16_length(found) >= 2) & ~found.isin(*words.NAME_REJECTS), found)

    quoted = F.regexp_extract(text, _QUOTED, 0)
    quoted = name(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    reviewed = name(extract(text, _REVIEWED))
    once = lambda t: reduce(lambda t, p: F.trim(F.regexp_replace(t, p, "")), _NEWS, t)
    # each useful pass takes four characters at least, so this many passes reach the fixpoint; none is made after it
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(text) / 2).cast("int")))
    one = lambda t: F.struct(t.alias("was"), F.when(any_of(t, _OPENING_TITLES), once(t)).otherwise(t).alias("now"))
    begun = F.struct(F.lit(None).cast("string").alias("was"), text.alias("now"))
    rest = F.aggregate(rounds, begun, lambda s, _: F.when(s["was"].eqNullSafe(s["now"]), s).otherwise(one(s["now"])), lambda s: s["now"])
    rest = F.trim(F.regexp_replace(rest, _TALK, ""))
    return F.coalesce(quoted, reviewed, F.when((rest != "") & ~rest.isin(*words.NAME_REJECTS), rest))


def is_opening_article(title: Column, content: Column) -> Column:
    return any_of(F.concat_ws(" ", title, content), _OPENING_ARTICLES)


def extract_station(text: Column) -> Column:
    """The first station's name of two to six characters that nothing runs into."""
    found = F.regexp_extract_all(text, F.lit(_JAPANESE + _STATION), 1)
    return F.try_element_at(F.filter(found, lambda s: ~s.rlike(f"(?:{'|'.join(words.STATION_REJECTS)})\\z")), F.lit(1))


def is_food_opening(title: Column, content: Column) -> Column:
    """Whether an article announces a new place to eat."""
    title, content = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    text = F.concat(title, F.lit(" "), content)
    opening = any_of(title, words.TITLE_OPENINGS) | (title.rlike(_STYLED) & any_of(content, _OPENING_TEXTS))
    closing = any_of(title, _CLOSING) & ~title.rlike(_OPENING_AGAIN)
    return opening & ~any_of(title, words.TITLE_REJECTS) & ~closing & ~any_of(text, words.NON_FOOD) & any_of(text, words.FOOD)


_DASHES = "ーｰ-‐‑–—―－"


def is_chain(name: Column) -> Column:
    """Whether a shop's name holds a national chain's, dashes and long vowel marks aside."""
    bare = str.maketrans("", "", _DASHES)
    return F.coalesce(any_of(F.translate(name, _DASHES, ""), [w.translate(bare) for w in words.CHAINS]), F.lit(False))
