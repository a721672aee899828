"""Near copies by the share of common word shingles: all pairs of 0.8 or more, found without comparing all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, durable, trimmed, utf8
from .simhash import grid_links
from .substrings import _Hashes, _mixed, window_hashes


#: Tasks that the nodes of a very common shingle are dealt to.
HOT_PARTS = 64


def _shingles(text: bytes, width: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, A-Z lower-cased; of a shorter text, one of all its words."""
    import xxhash

    ws = text.lower().split()  # of bytes: A-Z only, and the six ASCII white characters
    if len(ws) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 42)], np.uint64)
    return np.unique(_mixed(window_hashes(np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws)), width)))


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _fingerprint(shingles: np.ndarray) -> np.uint64:
    """The SimHash of distinct shingles: each votes with the bits of its hash, a bit is 1 if more than half have it."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0]


def _sent(n: int) -> int:
    """How many of ``n`` shingles, the smallest, a text sends."""
    return 2 * (n // 5) or 1


def _least_common(n: int) -> int:
    """How many of those that a text of ``n`` shingles sends a near copy sends too: its own fifth, of 0.8 * n at least."""
    return max(1, -(-4 * n // 5) // 5)


def _alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of the first that is reachable over pairs with 5 * common >= 4 * united."""
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    by_rarity = np.lexsort((flat, np.bincount(flat)[flat], owner))
    first = np.arange(len(flat)) - np.repeat(ends - n, n) <= np.repeat(n // 5, n)
    own, value = owner[first], flat[by_rarity][first]
    by_value, cuts = np.argsort(value, kind="stable"), np.concatenate([[0], np.cumsum(n // 5 + 1)])
    posted, posted_value = own[by_value], value[by_value]
    label, marked, left, held = np.full(len(sets), -1), np.zeros(len(values), bool), len(sets), len(sets)
    for s in range(len(sets)):
        if label[s] >= 0:
            continue
        label[s], left, frontier = s, left - 1, [s]
        while frontier and left:
            i = frontier.pop()
            if 2 * left < held:  # labelled sets go from the lists
                keep, held = label[posted] < 0, left
                posted, posted_value = posted[keep], posted_value[keep]
            if left <= 64:
                near = np.flatnonzero(label < 0)
            else:
                mine = value[cuts[i] : cuts[i + 1]]
                near = np.unique(np.concatenate([posted[a:b] for a, b in zip(np.searchsorted(posted_value, mine), np.searchsorted(posted_value, mine, "right"))]))
                near = near[label[near] < 0]
            near = near[5 * np.minimum(n[near], n[i]) >= 4 * np.maximum(n[near], n[i])]
            marked[flat[ends[i] - n[i] : ends[i]]] = True
            for at in range(0, len(near), 500):
                some = near[at : at + 500]
                common = np.add.reduceat(marked[np.concatenate([flat[ends[j] - n[j] : ends[j]] for j in some])], np.concatenate([[0], np.cumsum(n[some])[:-1]]), dtype=np.int64)
                found = some[5 * common >= 4 * (n[some] + n[i] - common)]
                label[found] = s
                left -= len(found)
                frontier += found.tolist()
            marked[flat[ends[i] - n[i] : ends[i]]] = False
    return label


def _similar(a, b):
    """Whether two arrays of distinct shingles have 0.8 or more in common (common by united)."""
    common = F.size(F.array_intersect(a, b))
    return 5 * common >= 4 * (F.size(a) + F.size(b) - common)


def _of_like_size(a: str, b: str):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """``posts`` (shingle, node, n) with the nodes' labels, of shingles whose nodes have two labels or more."""
    labels = labels.select("node", F.col("component").alias("label"))
    named = posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    return named.join(several, "shingle")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near copies."""
    one, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(one, "a").join(other, "b").where(_similar(F.col("of_a"), F.col("of_b"))).select("a", "b")


def _fingerprint_links(distinct: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """Near copies (a, b) among nodes whose fingerprints (bits) are equal or differ in at most ``radius`` bits."""
    named = durable(distinct.join(sets.select("node"), "node").select("node", "bits"))
    first = durable(named.groupBy("bits").agg(F.min("node").alias("first")))
    equal = named.join(first, "bits").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = grid_links(first, bits_col="bits", node_col="first", radius=radius)
    return _verified(equal.unionByName(near).distinct(), sets)


def _star_links(posts: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Near copies (a, b) among open posts, each node compared with one other for each of its shingles: the same for all nodes of the shingle."""
    centre = posts.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "label"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("c"))
    pairs = posts.join(centre, "shingle").where("label != c.label").where(_of_like_size("n", "c.n")).select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
    return _verified(pairs, sets)


def _block_links(posts: DataFrame, sets: DataFrame, chunk_shingles: int) -> DataFrame:
    """Links that connect all near copies among open posts, found by comparing chunks of nodes with each other.

    Nodes that are connected over shingles are compared with each other; they are cut into chunks of about
    ``chunk_shingles``, and two chunks meet in one task, but for those that have one label alone, the same. A label too
    large for a chunk has chunks of its own.
    """
    stars = posts.join(posts.groupBy("shingle").agg(F.min("node").alias("centre")), "shingle")
    near = components(stars.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    nodes = durable(posts.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label")).join(near, "node"))
    weigh = lambda *by: nodes.groupBy(*by).agg(F.ceil(F.sum("n") / chunk_shingles).alias("pieces"))
    large = weigh("component", "label").where("pieces > 1").withColumnRenamed("pieces", "own")
    dealt = nodes.join(weigh("component"), "component").join(large, ["component", "label"], "left")
    shared = F.struct(F.lit(None).cast("long").alias("label"), F.pmod(F.xxhash64("label"), "pieces").alias("k"))
    dealt = durable(dealt.select("component", "node", F.when(F.col("own").isNull(), shared).otherwise(F.struct("label", F.pmod(F.xxhash64("node"), "own").alias("k"))).alias("chunk")))
    chunks = dealt.select("component", "chunk").distinct()
    one, other = chunks.select("component", F.col("chunk").alias("x")), chunks.select("component", F.col("chunk").alias("y"))
    meet = one.join(other, "component").where("x = y AND x.label IS NULL OR x < y AND NOT (x.label IS NOT NULL AND x.label <=> y.label)")
    meet = meet.select("component", F.struct("x", "y").alias("meeting"), F.explode(F.array_distinct(F.array("x", "y"))).alias("chunk"))

    def compare(table: pa.Table) -> pa.Table:
        t = table.sort_by("node")
        label = _alike([np.asarray(s.values).view(np.uint64) for s in t["shingles"]])
        return pa.table({"a": t["node"], "b": t["node"].take(pa.array(label))})

    held = dealt.join(meet, ["component", "chunk"]).select("component", "meeting", "node").join(sets.select("node", "shingles"), "node")
    return held.groupBy("component", "meeting").applyInArrow(compare, "a long, b long").where("a != b")


def _common(rows: DataFrame, hashed, of: str, texts: int, sample_texts: int) -> DataFrame:
    """(shingle): those that one in sixteen of about ``sample_texts`` of the distinct texts sends; so many texts' worth by
    sixteen at most."""
    share = F.pmod(F.xxhash64("text"), F.lit(max(1, texts)))
    some = rows.where(share < sample_texts).mapInArrow(trimmed(hashed), of).dropDuplicates(["node"])
    least = max(8, min(texts, sample_texts) // 16)
    return durable(some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= least).select("shingle"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, rounds: int = 2, chunk_shingles: int = 1 << 20, sample_texts: int = 1 << 12, radius: int | None = None) -> DataFrame:
    """One row a document: id_col and component_id, the smallest id reachable over pairs of texts that are near copies.

    Near copies share 0.8 or more of their distinct shingles (common by united) of ``shingle_words`` words; A-Z is
    lower-cased, a shorter text is one shingle, and so are texts without words or null. No pair is left out:

    1. Texts of equal shingles are one node.
    2. Of n shingles a node sends 2 * (n // 5), the smallest (one at least). As near copies lack at most n // 5 of each
       other's, those two have in common at least what ``_least_common`` says.
    3. Of these it keeps, without so many less one, those that the fewest nodes sent; near copies have one of them in
       common. Nodes that do are candidates.
    4. In each of ``rounds`` a shingle's nodes are compared with one of them, so most of a large group of copies is
       connected at a cost in proportion to it. Shingles whose nodes are all connected are done.
       With a ``radius`` (up to 3) SimHash fingerprints of the shingles link first: nodes that differ in at most so many
       bits meet in a grid (``simhash.grid_links``), and those that are near copies are connected before any round, so
       the rounds have only what no fingerprint finds.
    5. Nodes of the others are compared in chunks of about ``chunk_shingles``, two chunks in a task, so no task holds
       a whole group; chunks that are connected already don't meet.

    Shingles that one in sixteen of about ``sample_texts`` texts sends are dealt to HOT_PARTS tasks each. Shingles and
    nodes are 64-bit hashes. Rows with a null id take part like others but name no component: one of
    theirs alone has a null component_id. Other columns go; repeated rows stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def hashed(batches, sent):
        """(id, node, how many shingles, shingles), of which only the first are sent; with none the fingerprint instead."""
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                each = [_shingles(t, shingle_words, hashes) for t in utf8(part.column("text"))]
                nodes, sizes = np.array([_node(s) for s in each], np.int64), np.array([len(s) for s in each], np.int64)
                each = [s[: sent(len(s))] for s in each] if sent else [np.array([_fingerprint(s)]) if radius is not None else s[:0] for s in each]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(nodes), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each).view(np.int64)))], ["id", "node", "n", "shingles"])

    of = "id long, node long, n long, shingles array<long>"
    prints = durable(rows.mapInArrow(trimmed(lambda b: hashed(b, None)), of).select("id", "node", F.try_element_at("shingles", F.lit(1)).alias("bits")))
    distinct = durable(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("bits").alias("bits")))

    sent = rows.mapInArrow(trimmed(lambda b: hashed(b, _sent)), of).select("node", "n", F.explode("shingles").alias("shingle"))
    # a shingle that a sample shows to be common is dealt to many tasks and counts as the commonest; any order of
    # shingles that is the same for all nodes finds all pairs
    hot = _common(rows, lambda b: hashed(b, _sent), of, distinct.count(), sample_texts).withColumn("hot", F.lit(True))
    sent = sent.join(F.broadcast(hot), "shingle", "left").select("node", "n", "shingle", F.when(F.col("hot"), F.pmod("node", F.lit(HOT_PARTS)) + 1).otherwise(0).alias("part"))
    sent = sent.repartition("shingle", "part").dropDuplicates(["shingle", "part", "node"])
    counted = F.when(F.col("part") > 0, F.lit(1 << 62)).otherwise(F.count("*").over(Window.partitionBy("shingle", "part")))
    shared = sent.withColumn("nodes", counted).where("nodes > 1")
    fifth, most = F.expr("n div 5"), F.expr("(4 * n + 4) div 5 div 5")  # as _sent and _least_common
    size = F.when(fifth == 0, 1).otherwise(2 * fifth)
    kept = size - F.greatest(most, F.lit(1)) + 1
    of_node = shared.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("nodes", "shingle"))).alias("own"))
    first = durable(of_node.select("node", "n", F.explode(F.slice("own", F.lit(1), F.greatest(F.lit(0), kept - size + F.size("own")).cast("int"))).alias("s")).select("node", "n", F.col("s.shingle").alias("shingle")))
    posts = durable(first.join(first.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1").select("shingle"), "shingle"), replaces=first)

    wanted = distinct.join(posts.select("node").distinct(), "node").select("least", F.col("node").alias("named"))
    texts = rows.join(wanted.select("least").distinct(), F.col("id").eqNullSafe(F.col("least")), "left_semi")
    again = texts.mapInArrow(trimmed(lambda b: hashed(b, lambda n: n)), of).join(wanted, F.col("node") == F.col("named")).where("id <=> least")
    sets = durable(again.select("node", "shingles").dropDuplicates(["node"]))

    links = durable(posts.sparkSession.createDataFrame([], "a long, b long"))
    labels = posts.sparkSession.createDataFrame([], "node long, component long")
    if radius is not None:
        links = durable(_fingerprint_links(distinct, sets, radius), replaces=links)
        labels = components(links)
    for turn in range(rounds):
        links = durable(links.unionByName(_star_links(_open(posts, labels), sets, turn)), replaces=links)
        labels = components(links)
    rest = durable(_open(posts, labels))
    if not rest.isEmpty():
        labels = components(durable(links.unionByName(_block_links(rest, sets, chunk_shingles))))
    least = distinct.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return prints.join(named, "node").select(F.col("id").alias(id_col), "component_id")
