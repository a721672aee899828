"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus's languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that for it as on with be by this are from at or an was not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}


@dataclass(frozen=True)
class Rule:
    """``value`` over ``per`` (1 if None) must be at least ``least`` and at most ``most``, where given."""

    value: str
    per: str | None = None
    least: float | None = None
    most: float | None = None

    def passes(self, metric) -> Column:
        value, per = metric(self.value), metric(self.per) if self.per else F.lit(1)
        tests = [value >= F.lit(float(self.least)) * per] if self.least is not None else []
        tests += [value <= F.lit(float(self.most)) * per] if self.most is not None else []
        return reduce(Column.__and__, tests, F.lit(True))


#: The thresholds. Lengths count words and code points; ratios are per word or per line.
RULES = (
    Rule("n_words", least=50),
    Rule("word_chars", "n_words", least=3, most=12),
    Rule("n_symbols", "n_words", most=0.1),
    Rule("n_stop_words", "n_words", least=0.06),
    Rule("n_dup_lines", "n_lines", most=0.5),
    Rule("n_repeat_words", "n_words", most=0.5),
)


def stop_forms(lists: dict[str, list[str]] = STOP_WORDS) -> list[str]:
    """Each stop word as it stands in running text: small or capital, bare or before a full stop or comma."""
    plain = sorted({w for ws in lists.values() for w in ws})
    return sorted({form + mark for w in plain for form in (w, w.capitalize()) for mark in ("", ".", ",")})


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated(ws: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            twin = lambda e, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == e["h"])) | ((i + 1 < F.size(s)) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == e["h"]))
            return F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        count = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(let(ordered, places), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), count, lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(ws) >= 3, found).otherwise(0)


def metrics(text: Column, stop_words: dict[str, list[str]] = STOP_WORDS) -> Column:
    """A struct of longs: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    Lines count if they have a word. Windows are compared by a 64-bit hash within their text.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    forms = stop_forms(stop_words)

    def of(ws: Column) -> Column:
        values = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_lines": let(lines, F.size),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": _repeated(ws),
            "n_stop_words": F.size(F.filter(ws, lambda w: w.isin(forms))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words(text), of)


def apply_rules(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``docs`` with quality, the struct of metrics, and passes, true if every rule holds.

    One projection without a shuffle. A null text has no words and, like an empty one, fails the rule on length; ratios
    are compared as products, so nothing divides by zero. Repeated rows each get their verdict; columns named quality
    or passes are replaced.
    """
    out = docs.withColumn("quality", metrics(F.col(text_col), stop_words))
    return out.withColumn("passes", reduce(Column.__and__, [r.passes(lambda name: F.col("quality")[name]) for r in rules]))
