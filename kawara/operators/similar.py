"""Names that are alike: a join on the similarity of their sets of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: What the least share in common may be short of the threshold by rounding.
_SLACK = 1e-9
#: Rows of rare trigrams in a part of the join, whose pairs are many for the rows' few bytes.
PART_ROWS = 1 << 14


def trigrams(name: Column) -> Column:
    """The distinct runs of three characters of a name with two spaces before and one behind it; null and empty names have none."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.when(F.length(name) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substr(padded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def similar_names(left: DataFrame, right: DataFrame, *, threshold: float, by: tuple[str, ...] = ("pref", "city"), name: str = "name") -> DataFrame:
    """Pairs of a name on the left and one on the right that are alike: (*by, left_name, right_name, similarity).

    Similarity is the share of trigrams in common, of all that either has; pairs of ``threshold`` (over 0) or more are
    listed, equal names among them, once each however many rows have the name. Nulls in ``by`` match nothing.

    Only a name's rarest trigrams are joined on: of n, sorted by how many names have them, one of the first
    n - ceil(threshold * n) + 1 must be among the other's first, too. Candidates of fitting sizes are then compared
    whole. So no names meet but those that share a rare trigram in one place, and neither all names of a place nor all
    that share a common trigram are paired.
    """
    held = lambda df: df.where(F.length(name) > 0).select(*by, F.col(name).alias("name")).dropna(subset=list(by)).distinct().withColumn("grams", trigrams(F.col("name")))
    sides = [durable(held(df)) for df in (left, right)]
    grams = sides[0].select(*by, F.explode("grams").alias("gram")).unionByName(sides[1].select(*by, F.explode("grams").alias("gram")))
    often = durable(grams.groupBy("gram").agg(F.count("*").alias("often")))

    def rarest(side: DataFrame) -> DataFrame:
        listed = side.select(*by, "name", F.explode("grams").alias("gram")).join(often, "gram")
        sorted_ = listed.groupBy(*by, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "gram"))), lambda x: x["gram"]).alias("grams"))
        n = F.size("grams")
        first = n - F.ceil(n * F.lit(threshold) - F.lit(_SLACK)).cast("int") + 1
        return sorted_.select(*by, "name", "grams", F.explode(F.slice("grams", F.lit(1), F.least(n, first))).alias("gram"))

    a, b = (rarest(s).select(*by, "gram", F.col("name").alias(f"{k}_name"), F.col("grams").alias(f"{k}_grams")) for s, k in zip(sides, ("left", "right")))
    # in so many parts by number: parts made by bytes are few, and each would have many pairs
    parts = max(1, 8 * (sides[0].count() + sides[1].count()) // PART_ROWS)
    a, b = (durable(x).repartition(parts, *by, "gram") for x in (a, b))
    met = a.join(b, [*by, "gram"])
    fit = F.least(F.size("left_grams"), F.size("right_grams")) >= F.greatest(F.size("left_grams"), F.size("right_grams")) * F.lit(threshold) - F.lit(_SLACK)
    # a pair that shares several of its rarest is kept where it shares the first of them
    first = F.element_at(F.array_intersect("left_grams", "right_grams"), 1) == F.col("gram")
    common = F.size(F.array_intersect("left_grams", "right_grams"))
    share = common / (F.size("left_grams") + F.size("right_grams") - common)
    return met.where(fit & first).withColumn("similarity", share).where(F.col("similarity") >= threshold - _SLACK).select(*by, "left_name", "right_name", "similarity")
