"""Which shop an article is about: one that is known, one that came earlier in the batch, or a new one."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .durable import durable, numbered
from .similar import similar_names

#: Characters of a name that a soft match looks for (fixed value).
PREFIX = 4


def name_tokens(name: Column) -> Column:
    """The distinct runs of letters and digits of a name."""
    return F.array_distinct(F.filter(F.split(name, r"[^\p{L}\p{N}]+", -1), lambda t: t != ""))


def _parts(name: Column, longest: int, starts: Column) -> Column:
    """The distinct parts of a name of up to ``longest`` characters that begin at ``starts``, an array of places from 1."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(name) - i + 1)), lambda n: F.substr(name, i, n)))))


#: How a store's name answers for an item's first characters: by a whole run of letters and digits, by its beginning,
#: or anywhere. Each gives what a name is known by, so a match is a join on equal keys.
SIMILAR = {
    "token": name_tokens,
    "prefix": lambda name: F.when(F.length(name) > 0, _parts(name, PREFIX, F.array(F.lit(1)))),
    "part": lambda name: F.when(F.length(name) > 0, _parts(name, PREFIX, F.sequence(F.lit(1), F.length(name)))),
}


def _first(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """The least ``at`` of each value of ``key``; nulls have none."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias(name))


def _with(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined to ``found``, one row a key. Rows of a null key, maybe most, aren't shuffled: they find nothing."""
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name != key]
    have, lack = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    return have.join(found, key, "left").select(*rows.columns, *[c for c in found.columns if c != key]).unionByName(lack.select(*rows.columns, *extra))


def leaders(items: DataFrame, *, rank: str = "rank", keys: tuple[str, ...] = ("tel", "name"), rounds: int = 3, fold_rows: int = 1 << 17) -> DataFrame:
    """``items`` with leads: true for those that, taken in order of ``rank``, share no key with a leader before them.

    That is the lexicographically first maximal independent set. While more than ``fold_rows`` items are open, up to
    ``rounds`` rounds decide most of them: an open item that comes first under each of its keys leads; open items that
    share a key with a leader don't. A round is a keyed minimum with a map-side combine and a join to one row a key,
    so no pairs are formed and a frequent key costs what a rare one does. What is open then are chains, each item
    waiting for the one before: they are cut into connected components, and each of these, or all of at most
    ``fold_rows`` items, is gone through in order once, by a task that holds the leaders' keys of one component. So a
    chain takes as many jobs as its logarithm says, or, if ``fold_rows`` hold it, a fixed number.

    ``rank`` must be distinct and not null; null keys are shared with nobody; no rows, no rounds.
    """
    unsure = durable(items.select(rank, *keys))
    decided, n = [], unsure.count()
    for _ in range(rounds):
        if n <= fold_rows:
            break
        marked, leads = unsure, F.lit(True)
        for k in keys:
            marked = _with(marked, _first(unsure, k, rank, f"{k}__first"), k)
            leads = leads & F.coalesce(F.col(f"{k}__first") == F.col(rank), F.lit(True))
        marked = durable(marked.select(rank, *keys, leads.alias("leads")))
        rest, gone = marked.where("NOT leads"), F.lit(False)
        for k in keys:
            taken = marked.where(F.col("leads") & F.col(k).isNotNull()).select(k, F.lit(True).alias(f"{k}__taken")).distinct()
            rest = _with(rest, taken, k)
            gone = gone | F.coalesce(F.col(f"{k}__taken"), F.lit(False))
        rest = durable(rest.select(rank, *keys, gone.alias("gone")))
        decided += [marked.where("leads").select(rank, "leads"), rest.where("gone").select(rank, F.lit(False).alias("leads"))]
        unsure = rest.where("NOT gone").drop("gone")
        n = unsure.count()
    part = F.lit(0).cast("long")
    if n > fold_rows:
        node = F.xxhash64(F.lit(-1), rank)
        edges = reduce(DataFrame.unionByName, [unsure.where(F.col(k).isNotNull()).select(node.alias("a"), F.xxhash64(F.lit(i), k).alias("b")) for i, k in enumerate(keys)])
        unsure = unsure.withColumn("node", node).join(components(edges), "node", "left")
        part = F.coalesce("component", "node")
    unsure = unsure.withColumn("part", part)
    dealt = unsure.repartition("part") if n > fold_rows else unsure.coalesce(1)
    schema = T.StructType([T.StructField(rank, items.schema[rank].dataType), T.StructField("leads", T.BooleanType())])
    decided.append(dealt.sortWithinPartitions("part", rank).select(rank, "part", *keys).mapInArrow(_fold, schema))
    return items.join(reduce(DataFrame.unionByName, decided), rank)


def _fold(batches):
    """Rows (rank, part, keys) in order of part and rank: whether each shares no key with a leader before it in its part."""
    seen, part = [], None
    for batch in batches:
        of, *keys = (c.to_pylist() for c in batch.columns[1:])
        leads = []
        for p, *own in zip(of, *keys):
            if p != part:
                part, seen = p, [set() for _ in own]
            leads.append(not any(k is not None and k in s for k, s in zip(own, seen)))
            if leads[-1]:
                for k, s in zip(own, seen):
                    s.add(k)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leads, pa.bool_())], [batch.schema.names[0], "leads"])


def resolve(items: DataFrame, stores: DataFrame, *, rank: str = "rank", first_id: int | None = None, similar: str | float = "token", fold_rows: int = 1 << 17) -> DataFrame:
    """``items`` with outcome ('merged', 'soft' or 'new'), store_id and duplicate_of_id.

    ``items`` has tel_normalized, name_normalized, pref, city and ``rank``, distinct and ordered as the items came;
    ``stores`` has id and those four columns. In that order, an item

    - is merged into the store with its phone number, else into that with its name, anywhere, that was known before
      it, from an earlier batch or from this one;
    - else makes a new store, soft if a store before it in its city has a name that is ``similar``: one run of its
      letters and digits equals the item's first four characters ("token"), it begins with them ("prefix") or has them
      anywhere ("part"), or, where ``similar`` is a number, so large a share of both names' trigrams or more is common
      to them (``similar_names``); duplicate_of_id is that store.

    Where several stores fit, the one with the least id does. Merged items add no keys, so this isn't the same as
    connected components. New stores are numbered in order of rank from ``first_id``, or after the largest id. Null
    phone numbers match nothing; empty names match each other.
    """
    items = durable(items)
    tel, name = "tel_normalized", "name_normalized"
    stores = stores.select("id", tel, name, "pref", "city")
    # only stores that share a key with the batch are gathered: a small batch is broadcast to the scan
    near = lambda key: stores.join(items.select(key).distinct(), key, "left_semi")
    known_tel = _first(near(tel), tel, "id", "known_tel")
    known_name = _first(near(name), name, "id", "known_name")
    found = durable(_with(_with(items, known_tel, tel), known_name, name))
    fresh = found.where("known_tel IS NULL AND known_name IS NULL")
    led = leaders(fresh.select(rank, tel, name, "pref", "city"), rank=rank, keys=(tel, name), fold_rows=fold_rows)
    if first_id is None:
        first_id = (stores.agg(F.max("id")).first()[0] or 0) + 1
    made = numbered(led.where("leads").select(rank, tel, name, "pref", "city"), [F.col(rank)], "store_id", first_id)

    # of the stores made here, at most one has a number or a name
    by_tel = made.where(F.col(tel).isNotNull()).select(tel, F.col(rank).alias("tel_rank"), F.col("store_id").alias("tel_store"))
    by_name = made.where(F.col(name).isNotNull()).select(name, F.col(rank).alias("name_rank"), F.col("store_id").alias("name_store"))
    before = lambda c: F.when(F.col(f"{c}_rank") <= F.col(rank), F.col(f"{c}_store"))
    placed = _with(_with(found, by_tel, tel), by_name, name)
    placed = placed.withColumn("store_id", F.coalesce("known_tel", before("tel"), "known_name", before("name")))

    if not isinstance(similar, str):
        alike = _alike(made, stores, rank, name, similar)
        return _outcomes(items, placed, made.select(rank, F.col("store_id").alias("made")).join(alike, rank, "left"), rank)
    words = lambda df, at: df.select("pref", "city", F.explode(SIMILAR[similar](F.col(name))).alias("word"), at)
    begun = made.withColumn("word", F.substring(name, 1, PREFIX))
    asked = begun.select("pref", "city", "word").distinct()
    old = words(stores, F.col("id").alias("at")).join(asked, ["pref", "city", "word"], "left_semi").groupBy("pref", "city", "word").agg(F.min("at").alias("old_store"))
    new = words(made, F.struct(F.col(rank), F.col("store_id")).alias("at")).groupBy("pref", "city", "word").agg(F.min("at").alias("new_store"))
    similar = begun.join(old, ["pref", "city", "word"], "left").join(new, ["pref", "city", "word"], "left")
    earlier = F.when(F.col(f"new_store.{rank}") < F.col(rank), F.col("new_store.store_id"))
    similar = similar.select(rank, F.coalesce("old_store", earlier).alias("duplicate_of_id"), F.col("store_id").alias("made"))
    return _outcomes(items, placed, similar, rank)


def _outcomes(items: DataFrame, placed: DataFrame, made: DataFrame, rank: str) -> DataFrame:
    """``placed`` with outcome, by ``made`` (rank, duplicate_of_id, made), a row for each item that made a store, with its id."""
    out = placed.join(made, rank, "left").withColumn("store_id", F.coalesce("store_id", "made"))  # one without keys isn't found by them
    outcome = F.when(F.col("made").isNull(), "merged").when(F.col("duplicate_of_id").isNotNull(), "soft").otherwise("new")
    return out.withColumn("outcome", outcome).select(*items.columns, "outcome", "store_id", "duplicate_of_id")


def _alike(made: DataFrame, stores: DataFrame, rank: str, name: str, threshold: float) -> DataFrame:
    """(rank, duplicate_of_id): the store with the least id among those before each made one whose names are alike."""
    named = lambda df, *more: df.select("pref", "city", F.col(name).alias("name"), *more)
    old = named(stores, F.col("id").alias("store_id"), F.lit(None).cast(made.schema[rank].dataType).alias("rank_"))
    all_ = durable(old.unionByName(named(made, "store_id", F.col(rank).alias("rank_"))))
    pairs = similar_names(named(made), all_, threshold=threshold)
    first = all_.groupBy("pref", "city", "name").agg(F.min(F.struct("store_id", "rank_")).alias("first"))  # made names differ, so only old ones repeat
    asked = pairs.join(made.select(rank, "pref", "city", F.col(name).alias("left_name")), ["pref", "city", "left_name"])
    found = asked.join(first.withColumnRenamed("name", "right_name"), ["pref", "city", "right_name"])
    return found.where(F.col("first.rank_").isNull() | (F.col("first.rank_") < F.col(rank))).groupBy(rank).agg(F.min("first.store_id").alias("duplicate_of_id"))


def resolve_one_by_one(items: list[dict], stores: list[dict], similar: str | float = "token") -> list[tuple[str, int, int | None]]:
    """What resolve() must return, item by item in order: the definition, for small inputs and tests."""
    known, out = [dict(s) for s in stores], []
    grams = lambda n: {f"  {n} "[k : k + 3] for k in range(len(n) + 1)} if n else set()
    begins = {"token": lambda start, n: start in re.split(r"[\W_]+", n), "prefix": lambda start, n: n.startswith(start), "part": lambda start, n: start in n}
    like = (lambda own, n: begins[similar](own[:PREFIX], n)) if isinstance(similar, str) else lambda own, n: bool(n) and len(grams(own) & grams(n)) / len(grams(own) | grams(n)) >= similar - 1e-9
    next_id = max((s["id"] for s in known), default=0) + 1
    for x in items:
        hits = [s["id"] for s in known if x["tel_normalized"] is not None and s["tel_normalized"] == x["tel_normalized"]]
        hits = hits or [s["id"] for s in known if x["name_normalized"] is not None and s["name_normalized"] == x["name_normalized"]]
        if hits:
            out.append(("merged", min(hits), None))
            continue
        own = x["name_normalized"] or ""
        alike = [s["id"] for s in known if own and (s["pref"], s["city"]) == (x["pref"], x["city"]) and like(own, s["name_normalized"] or "")]
        out.append(("soft" if alike else "new", next_id, min(alike, default=None)))
        known.append({**x, "id": next_id})
        next_id += 1
    return out
