"""Toxicity of texts: boosted trees over dense features of a learnt lexicon and of manner, calibrated to a probability."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fields, free

#: Second-person words of the languages that such corpora mostly hold (fixed values).
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vos".split())
#: Common insults in the same languages, known before any label is seen (fixed values).
SEEDS = frozenset("ass bastard bitch clown coward creep crap cretin damn degenerate disgrace disgusting dumb fool freak garbage hate idiot ignorant imbecile jerk liar loser moron nasty pathetic pig rat retard scum shit sick stupid trash ugly useless vermin vile worthless abschaum arschloch blöd dreck dumm dummkopf ekelhaft hässlich idioten lügner schwein versager widerlich connard crétin débile dégueulasse imbécile minable nul ordure pourri raclure salaud stupide asco asqueroso basura cerdo cobarde despreciable escoria estúpido idiota imbécil inútil mierda patético payaso tonto".split())
#: What a seed weighs unless the labels say otherwise.
SEED_WEIGHT = 2.0
#: What stands for a letter in a masked word (fixed values).
MASKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
#: Parts of the labelled texts, each of which gets its features from the others' lexicon.
FOLDS = 8
#: Words around a lexicon's word in which a second person counts as near it.
NEAR = 5
#: The first characters of a word that a lexicon may know it by, as it may by all.
STEMS = (3, 4, 5, 6)
FEATURES = ("strong_density", "hit_density", "weight_density", "strong_count", "hit_count", "distinct_hits", "heaviest", "near_second_person", "second_person", "capitals", "shouted_words", "exclamations", "punctuation", "masked_words", "masked_hits", "words")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+\Z")
_MASKED = re.compile(r"[^\W\d_][0-9@$!|€*#]+(?=[^\W_])|[0-9@$!|€]+[^\W\d_]")
_STRONG, _HIT, _YOU, _SHOUT, _MASK, _MASK_HIT, _SINGLE = (1 << k for k in range(7))


def core(word: str) -> str:
    """A word without the marks around it, in lower case; letters put back where others stand for them."""
    out = _EDGES.sub("", word).lower()
    return out if out.isalpha() else "".join(c for c in (out.translate(MASKS) if _MASKED.search(word) else out) if c.isalpha())


def terms(word: str) -> list[str]:
    """What a lexicon may know a word by: itself, then its beginnings, the longest first, each marked by a star."""
    return [word, *(word[:k] + "*" for k in reversed(STEMS) if k < len(word))] if word else []


class Lexicon(dict):
    """A word's code, made when first asked for: flags, and its weight in 64ths from bit 8 on. ``weights`` has a term's
    weight and whether it is strong; a word takes that of the longest term that fits."""

    def __init__(self, weights: dict[str, tuple[float, bool]], room: int = 300_000):
        self.weights, self.room = weights, room

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:  # codes only save time
            self.clear()
        plain, code = core(word), 0
        found = next((self.weights[t] for t in terms(plain) if t in self.weights), None)
        masked = bool(_MASKED.search(word)) and bool(plain)
        if found:
            code = _HIT | _STRONG * found[1] | _MASK_HIT * masked | int(found[0] * 64) << 8
        code |= _YOU * (plain in SECOND_PERSON) | _MASK * masked | _SHOUT * (len(plain) > 2 and _EDGES.sub("", word).isupper()) | _SINGLE * (len(plain) == 1)
        self[word] = code
        return code


def features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of a text: rates by word or character, counts as logarithms."""
    words = _WORD.findall(text)
    n = len(words)
    codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, n)
    flagged = np.flatnonzero(codes)
    at = flagged[codes[flagged] & _HIT > 0]
    hits = codes[at]
    spelt = _spelt_out(words, codes, lexicon)
    weights = np.concatenate([hits >> 8, [c >> 8 for c in spelt]]) / 64
    strong = int(np.count_nonzero(hits & _STRONG)) + sum(bool(c & _STRONG) for c in spelt)
    you = flagged[codes[flagged] & _YOU > 0]
    near = np.searchsorted(you, at + NEAR, "right") > np.searchsorted(you, at - NEAR)
    rate = lambda x, of: float(x) / max(1, of)
    count = lambda flag: np.count_nonzero(codes[flagged] & flag)
    capitals = sum(map(str.isupper, text)) if text != text.lower() else 0
    return [
        rate(strong, n), rate(len(weights), n), rate(weights.sum(), n), float(np.log1p(strong)), float(np.log1p(len(weights))), float(np.log1p(len({words[i] for i in at}) + len(spelt))), float(weights.max(initial=0)),
        rate(np.count_nonzero(near), n), rate(len(you), n), rate(capitals, len(text)), rate(count(_SHOUT), n), rate(text.count("!"), len(text)),
        rate(len(text) - sum(map(len, re.findall(r"[\w\s]+", text))), len(text)), rate(count(_MASK) + len(spelt), n), rate(np.count_nonzero(hits & _MASK_HIT) + len(spelt), n), float(np.log1p(n)),
    ]


def _spelt_out(words: list[str], codes: np.ndarray, lexicon: Lexicon) -> list[int]:
    """Codes of lexicon words that are written letter by letter: four or more words of one letter in a row."""
    single = np.flatnonzero(codes & _SINGLE)
    out = []
    for _, run in groupby(enumerate(single.tolist()), key=lambda x: x[1] - x[0]):
        found = [i for _, i in run]
        if len(found) >= 4:
            code = lexicon["".join(core(words[i]) for i in found)]
            out += [code] * bool(code & _HIT)
    return out


def with_features(docs: DataFrame, weights: list[dict[str, tuple[float, bool]]], text_col: str, name: str, which: str | None = None) -> DataFrame:
    """``docs`` with ``name``, the features of each text in the order of FEATURES, by the lexicon whose number stands in
    ``which``, else the first. Null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # at most lexicon_size terms each
    schema = T.StructType([*fields(docs), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        lexicons = [Lexicon(w, 300_000 // len(held.value)) for w in held.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                of = part.column(which).to_pylist() if which else [0] * part.num_rows
                found = pa.array([features(t or "", lexicons[k]) for t, k in zip(part.column(text_col).to_pylist(), of)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], schema.names)

    return docs.mapInArrow(run, schema)


def term_counts(sample: DataFrame, text_col: str, group_col: str, groups: int, room: int = 400_000) -> DataFrame:
    """(term, n array<long>): the number of texts of each group (0 to ``groups`` - 1) that hold a term.

    A task adds up its own texts' terms first, up to ``room`` of them at a time.
    """

    def run(batches):
        def told():
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([g for _, g in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["term", "g", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text, group in zip(batch.column(text_col).to_pylist(), batch.column(group_col).to_pylist()):
                held.update({(t, group) for w in {core(w) for w in set(_WORD.findall(text or ""))} for t in terms(w)})
                if len(held) > room:
                    yield told()
                    held.clear()
        yield told()

    counted = sample.select(text_col, group_col).mapInArrow(run, "term string, g int, n long")
    return counted.groupBy("term").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n"))), F.lit(0)) for g in range(groups)]).alias("n"))


def log_odds(t: Column, c: Column, toxic: int, clean: int) -> tuple[Column, Column]:
    """How much likelier a toxic text holds a term, as a logarithm, and how sure that is (twice the log likelihood ratio)."""
    part = lambda n, of: F.when(n > 0, n * F.log(n / ((t + c) * F.lit(of / max(1, toxic + clean))))).otherwise(0.0)
    return F.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))), 2 * (part(t, toxic) + part(c, clean))


@dataclass
class Model:
    """What ``fit`` learns; ``trees`` and ``steps`` are None where the labels have one class only, whose share all get."""

    weights: dict[str, tuple[float, bool]]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """``docs`` with score, from 0 to 1, higher where the text is likelier toxic; null texts count as empty.

        Nothing but the text is looked at. No shuffle; a column named score is replaced; repeated rows score alike.
        """
        docs = docs.drop("score")
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.share))
        (found,) = free(docs, "found")
        out = _margin(self.trees, with_features(docs, [self.weights], text_col, found), found)
        scored = self.steps.transform(out)
        return scored.select(*docs.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(self.steps.getPredictionCol()))).alias("score"))


def _margin(trees: GBTClassificationModel, docs: DataFrame, found: str) -> DataFrame:
    raw, vector = "toxicity__raw", trees.getFeaturesCol()
    out = trees.transform(docs.withColumn(vector, array_to_vector(found)))
    return out.withColumn("toxicity__margin", vector_to_array(F.col(raw))[1]).drop(raw, vector, found)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text_col: str = "text",
    key_col: str = "doc_id",
    label_col: str = "toxic",
    train_rows: int = 1 << 15,
    lexicon_size: int = 1 << 16,
    sure: float = 8.0,
    strong: float = 20.0,
    trees: int = 20,
    depth: int = 3,
    rate: float = 0.2,
) -> Model:
    """A model of ``labels`` (key, 0 or 1; nulls are left out, of several the largest counts) over the texts of ``docs``.

    It learns from about ``train_rows`` labelled keys, taken by a hash of the key where there are more. Of their texts

    1. Spark counts for each word and word beginning the toxic and clean texts that hold it; what is at least three
       times likelier in toxic ones, and surely so, makes the lexicon, the ``lexicon_size`` surest of it, with SEEDS;
    2. each of FOLDS parts (by hash of the text) gets its features from the other parts' lexicon, lest a rare word tell
       its own text's label;
    3. boosted trees learn from three quarters of them, and isotonic regression of the label on their margin from the
       rest, or from all where the rest has fewer than ten of a class.

    Equal texts count once, with the largest label. No labels, or labels of one class: every text gets that class's
    share as its score.
    """
    wanted = labels.where(F.col(key_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(key_col).agg(F.max(label_col).cast("int").alias("y"))
    n = wanted.count()
    if n > train_rows:
        wanted = wanted.where(F.pmod(F.xxhash64(key_col), F.lit(n)) < train_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_text = lambda seed, n: F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(n)).cast("int")
    labelled = docs.select(key_col, text_col).join(F.broadcast(wanted), key_col).select(text.alias("text"), "y")  # about train_rows rows of two numbers
    sample = durable(labelled.groupBy("text").agg(F.max("y").alias("y")).select("text", "y", by_text(1, FOLDS).alias("fold"), by_text(2, 4).alias("quarter")).withColumn("g", 2 * F.col("fold") + F.col("y")))
    rows = {(r.fold, r.y): r.n for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    size = lambda y, but=None: sum(n for (f, k), n in rows.items() if k == y and f != but)
    share = size(1) / max(1, size(0) + size(1))
    if not 0 < share < 1:
        return Model({}, None, None, share)

    count = lambda y, but=None: sum((F.col("n")[2 * f + y] for f in range(FOLDS) if f != but), F.lit(0))
    judged = {k: log_odds(count(1, k), count(0, k), size(1, k), size(0, k)) for k in (None, *range(FOLDS))}
    told = term_counts(sample, "text", "g", 2 * FOLDS).where(count(1) > 1)
    told = told.select("term", judged[None][1].alias("sureness"), F.array(*[F.when((w >= float(np.log(3))) & (g >= sure), F.struct(w.alias("w"), (g >= strong).alias("strong"))) for w, g in judged.values()]).alias("as"))
    told = told.where(F.exists("as", lambda x: x.isNotNull())).orderBy(F.col("sureness").desc(), "term").limit(lexicon_size).collect()  # bounded by lexicon_size
    seeds = dict.fromkeys(SEEDS, (SEED_WEIGHT, True))
    whole, *others = (seeds | {r.term: (r["as"][k].w, r["as"][k].strong) for r in told if r["as"][k]} for k in range(FOLDS + 1))

    ready = durable(with_features(sample, others, "text", "found", "fold").select("found", F.col("y").cast("double").alias("y"), "quarter")).coalesce(4)  # about train_rows rows of sixteen numbers
    most = ready.where("quarter != 3")
    if most.select("y").distinct().count() < 2:
        most = ready
    learner = GBTClassifier(featuresCol="toxicity__features", labelCol="y", predictionCol="", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=4, seed=7).setRawPredictionCol("toxicity__raw").setProbabilityCol("")
    model = learner.fit(most.withColumn("toxicity__features", array_to_vector("found")))
    rest = durable(_margin(model, ready, "found"))
    of = {r.y: r.n for r in rest.where("quarter = 3").groupBy("y").agg(F.count("*").alias("n")).collect()}
    enough = min(of.get(0.0, 0), of.get(1.0, 0)) >= 10
    steps = IsotonicRegression(featuresCol="toxicity__margin", labelCol="y", predictionCol="toxicity__score").fit(rest.where("quarter = 3") if enough else rest)
    return Model(whole, model, steps, share)
