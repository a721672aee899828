"""Approximate nearest neighbours by inner product, over balanced posting lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Nodes that a search of the graph expands at a time.
EXPANDED = 8

#: Vectors longer than so many times the median, or than this, are compared with every query: beside them the lengths
#: of the others, or all squares, would be lost.
WIDE, WIDEST = 1e3, 1e100


def balanced_centroids(points: np.ndarray, lists: int, moves: int = 5) -> np.ndarray:
    """``lists`` centroids of about equal shares of the points; close ones are close in order.

    The points are cut into equal parts, each time across the main axis; their means then move ``moves`` times to the
    middle of the points nearest to them, which from equal parts keeps the shares about equal.
    """
    out = []

    def cut(own: np.ndarray, k: int) -> None:
        if k == 1:
            out.append(own.mean(axis=0))
            return
        centred = own - own.mean(axis=0)
        axis = np.ones(own.shape[1])
        for _ in range(8):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) or 1
        order = np.argsort(centred @ axis, kind="stable")
        left = k // 2
        at = len(own) * left // k
        cut(own[order[:at]], left)
        cut(own[order[at:]], k - left)

    cut(points, lists)
    centroids = np.array(out)
    for _ in range(moves):
        square = (centroids**2).sum(axis=1)
        nearest = np.concatenate([(square[None] - 2 * points[i : i + 2048] @ centroids.T).argmin(axis=1) for i in range(0, len(points), 2048)])
        order, counts = np.argsort(nearest, kind="stable"), np.bincount(nearest, minlength=lists)
        used = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[used]
        centroids[used] = np.add.reduceat(points[order], starts, axis=0) / counts[used][:, None]
    return centroids


def centroid_graph(centroids: np.ndarray, degree: int = 24, back: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centroids, each one's links (to its nearest, to some that it is near to, to some further along the order), and where searches begin."""
    n, square = len(centroids), (centroids**2).sum(axis=1)
    near = np.empty((n, min(degree, n)), np.int64)
    for i in range(0, n, 1024):
        d = square[None] - 2 * centroids[i : i + 1024] @ centroids.T
        near[i : i + 1024] = np.argpartition(d, min(degree, n) - 1, axis=1)[:, : min(degree, n)]
    far = (np.arange(n)[:, None] + (np.arange(1, 9) * max(1, n // 9))[None]) % n
    to, source = near.ravel(), np.repeat(np.arange(n), near.shape[1])
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    reverse = np.repeat(np.arange(n)[:, None], back, axis=1)
    reverse[to[place < back], place[place < back]] = source[place < back]
    return centroids, np.concatenate([near, reverse, far], axis=1), np.unique(np.linspace(0, n - 1, min(n, int(4 * n**0.5))).astype(np.int64))


def nearest_centroids(graph: tuple[np.ndarray, np.ndarray, np.ndarray], points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point, up to ``beam`` centroids found best first and their squared distances, nearest first; -1 and inf fill up."""
    centroids, links_of, entries = graph
    n, m = len(points), len(centroids)
    beam, own_square = min(beam, m), (centroids**2).sum(axis=1)
    square = (points**2).sum(axis=1)
    seen = np.zeros((n, m), bool)
    who = np.broadcast_to(entries, (n, len(entries))).copy()
    seen[:, entries] = True
    dist = np.maximum(0, square[:, None] + own_square[None, entries] - 2 * points @ centroids[entries].T)
    done = np.zeros(who.shape, bool)
    while True:
        if who.shape[1] > beam:
            keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            who, dist, done = (np.take_along_axis(x, keep, axis=1) for x in (who, dist, done))
        open_dist = np.where(done, np.inf, dist)
        some = min(EXPANDED, who.shape[1])
        best = np.argpartition(open_dist, some - 1, axis=1)[:, :some]
        active = np.isfinite(np.take_along_axis(open_dist, best, axis=1))
        if not active.any():
            break
        np.put_along_axis(done, best, True, axis=1)
        links = np.where(active[:, :, None], links_of[np.where(active, np.take_along_axis(who, best, axis=1), 0)], -1).reshape(n, -1)
        links.sort(axis=1)
        fresh = ~np.take_along_axis(seen, links, axis=1) & (links >= 0)
        fresh[:, 1:] &= links[:, 1:] != links[:, :-1]
        r, c = np.nonzero(fresh)
        seen[r, links[r, c]] = True
        d = np.full(links.shape, np.inf)
        d[r, c] = np.maximum(0, square[r] + own_square[links[r, c]] - 2 * np.einsum("ij,ij->i", points[r], centroids[links[r, c]]))
        who, dist, done = np.concatenate([who, np.where(fresh, links, -1)], axis=1), np.concatenate([dist, d], axis=1), np.concatenate([done, ~fresh], axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    who, dist = np.take_along_axis(who, order, axis=1), np.take_along_axis(dist, order, axis=1)
    return np.where(np.isfinite(dist), who, -1), dist


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def needed_ratio(centroids: np.ndarray, points: np.ndarray, raw: np.ndarray, k: int, replicas: int, replica_ratio: float, recall: float, tries: int = 256) -> float:
    """How much further than its nearest list a query must look for a share ``recall`` of its neighbours, by the points themselves.

    The first ``tries`` points are queries; their ``k`` best inner products among all points are found by brute force
    and looked up in their own lists. ``points`` are ``raw`` with the component that makes norms equal.
    """
    asked = raw[:tries]
    most = (points[0] ** 2).sum()
    lifted = np.concatenate([asked * np.sqrt(most) / np.linalg.norm(asked, axis=1)[:, None], np.zeros((len(asked), 1))], axis=1)
    far = lambda x: np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T))
    to_lists, out = far(lifted), []
    for i, one in enumerate(asked):
        row = raw @ one
        row[i] = -np.inf
        best = np.argpartition(-row, min(k, len(row) - 1))[:k] if len(row) > 1 else np.zeros(0, np.int64)
        own = far(points[best])
        near = np.argsort(own, axis=1)[:, :replicas]
        reach = np.take_along_axis(own, near, axis=1)
        seen = np.where(reach <= replica_ratio * reach[:, :1], to_lists[i][near], np.inf).min(axis=1)
        if to_lists[i].min() > 0:
            out.append(seen / to_lists[i].min())
    return float(np.quantile(np.concatenate(out), recall)) if out else 1.0


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, pair by pair, in double precision and summed in order, so equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(queries))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(queries.shape[1]):
            out += queries[:, d] * vectors[:, d]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 1 << 16, bound_rows: int = 1 << 12, list_rows: int = 512, replicas: int = 2, replica_ratio: float = 1.05, recall: float = 0.965, beam: int = 128, least_met: int = 1000, chunk_rows: int = 1 << 13, query_rows: int = 1 << 13) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest found rows of ``vectors`` but itself: query_id, rank, vec_id, score.

    Nearness is the largest inner product. Vectors get one more component that makes all norms equal, which turns it
    into the smallest distance.

    1. Centroids come from a sample of about ``sample_rows`` vectors, cut into equal parts; there is one for about
       ``list_rows`` rows, at most an eighth of the sample. They, the graph over them and ``bound_rows`` vectors of the
       sample (an eighth at most), with which every query is compared, are all that a task holds whole, so their size
       is bounded whatever the table.
    2. Every vector joins its nearest list and up to ``replicas`` - 1 more whose centroid is at most ``replica_ratio``
       times as far: those near a boundary stand in several lists.
    3. A query searches the graph and selects the lists up to a ratio times as far as the nearest, and as many more as
       it takes to meet ``least_met`` vectors (or k others). The ratio is the one with which queries from the sample
       find a share ``recall`` of their true neighbours in it. A query for which ``beam`` lists are too few measures
       its distance to every centroid. Small tables are searched whole.
    4. Lists close in order share a bucket of at most ``chunk_rows`` vectors; longer lists are split into chunks, and so
       are many queries to one bucket. A chunk scores each query against the lists that it selected, no others, and
       drops what scores less than the query's k-th best of those of the sample, which are answers themselves.

    Of equal vectors only the ``k`` + 1 with the smallest ids are kept: ties go to smaller ids and a query misses only
    itself, so no other copy can be in an answer, and a vector that makes up a third of all rows is no list of its own.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id.
    A product of two vectors needs equal lengths. Vectors of another length than most, and those much longer
    (``WIDE``), aren't in the lists: every query of their length is compared with them, in blocks; a product that isn't a
    number is no answer. Rows with one id count as one, by their best score; a query never finds its own id. Ties go to
    the smaller id. Other columns go.
    """
    spark = vectors.sparkSession
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    tidy = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(good)
    vectors, queries = tidy(vectors), tidy(queries)
    copies = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    vectors = durable(vectors.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    middle = vectors.agg(F.percentile_approx(F.sqrt(norm), 0.5)).first()[0] or 0.0
    vectors = vectors.withColumn("wide", F.sqrt(norm) > min(WIDE * middle, WIDEST))
    kinds = vectors.groupBy(F.size("vector").alias("size"), "wide").agg(F.count("*").alias("rows"), F.max(norm).alias("norm")).orderBy("wide", F.desc("rows"), "size").collect()  # a row a length
    if not kinds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, plain, rows, most = kinds[0]
    listed = vectors.where((F.size("vector") == size) & F.lit(not plain) & ~F.col("wide"))
    rows, most = (0, 1.0) if plain else (rows, most)
    share = min(1.0, sample_rows / max(1, rows))
    picked = listed.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow() if rows else None
    picked = picked.take(pa.array(np.random.default_rng(0).permutation(picked.num_rows))) if rows else None
    sample = _matrix(picked["vector"]) if rows and picked.num_rows else np.zeros((0, size))
    lift = lambda m: np.concatenate([m, np.sqrt(np.maximum(0, most - (m**2).sum(axis=1)))[:, None]], axis=1)
    lists = int(max(1, min(rows / list_rows, len(sample) / 8)))
    centroids = balanced_centroids(lift(sample), lists) if len(sample) else np.zeros((1, size + 1))
    probe_ratio = needed_ratio(centroids, lift(sample), sample, k, replicas, replica_ratio, recall) if len(sample) else 1.0
    graph = spark.sparkContext.broadcast(centroid_graph(centroids))
    known = np.unique(picked["id"].to_numpy()[: min(bound_rows, len(sample) // 8)], return_index=True) if len(sample) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    bounds = spark.sparkContext.broadcast((known[0], sample[known[1]]))
    least_met = max(least_met, k + 1)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                who, dist = nearest_centroids(graph.value, lift(_matrix(part.column("vector"))), 8 * replicas)
                near = (who >= 0) & (np.sqrt(dist) <= replica_ratio * np.sqrt(dist[:, :1]))
                near[:, replicas:] = False
                near[:, 0] = True
                r, c = np.nonzero(near)
                took = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(who[r, c]), pa.array(c == 0)], ["id", "vector", "list", "own"])

    members = durable(listed.select("id", "vector").mapInArrow(assign, "id long, vector array<double>, list long, own boolean"))
    counts = members.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect()  # a row a list at most
    total = sum(r.n for r in counts)
    chunk_rows = min(chunk_rows, max(256, total // 64))  # some buckets for every core, even in a small table
    per_bucket = max(1, int(chunk_rows * lists / max(1, total)))
    alone, full = np.zeros(lists, np.int64), np.zeros(-(-lists // per_bucket), np.int64)
    for r in counts:
        alone[r.list] = r.own
        full[r.list // per_bucket] += r.n

    def near_sample(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rough scores of queries with the sample's vectors, but for their own ids; the ids; what a k-th best answer has at least."""
        (ids, some), raw = bounds.value, _matrix(part.column("vector"))
        with np.errstate(over="ignore", invalid="ignore"):
            scores = raw @ some.T
        scores[np.isnan(scores) | (part.column("id").to_numpy()[:, None] == ids[None])] = -np.inf
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(raw), -np.inf)
        return scores, ids, np.where(np.isfinite(bound), bound, -np.inf)

    def from_sample(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores, ids, bound = near_sample(part)
                q, v = np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))
                asking, points = part.column("id").to_numpy(), _matrix(part.column("vector"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(asking[q], ids[v], _scores(points[q], bounds.value[1][v]), k)], ["query_id", "vec_id", "score"])

    def probe(batches):
        centres = graph.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = _matrix(part.column("vector"))
                _, _, bound = near_sample(part)
                points = raw / np.abs(raw).max(axis=1)[:, None]
                points *= np.sqrt(most) / np.linalg.norm(points, axis=1)[:, None]
                who, dist = nearest_centroids(graph.value, np.concatenate([points, np.zeros((len(points), 1))], axis=1), beam)
                met = np.cumsum(np.where(who >= 0, alone[who], 0), axis=1)
                take = (who >= 0) & ((np.sqrt(dist) <= probe_ratio * np.sqrt(dist[:, :1])) | (met - np.where(who >= 0, alone[who], 0) < least_met))
                at_query, buckets, picked = [], [], []
                for i in range(len(points)):
                    own = who[i][take[i]]
                    if len(own) == who.shape[1] < lists:  # the beam ends before the ratio or the least number does
                        whole = np.sqrt(np.maximum(0, most + (centres**2).sum(axis=1) - 2 * centres[:, :-1] @ points[i]))
                        order = np.argsort(whole, kind="stable")
                        before = np.cumsum(alone[order]) - alone[order]
                        own = order[(whole[order] <= probe_ratio * whole[order[0]]) | (before < least_met)]
                    own = np.sort(own)
                    cuts = np.flatnonzero(np.diff(own // per_bucket, prepend=-1))
                    at_query += [i] * len(cuts)
                    buckets += (own[cuts] // per_bucket).tolist()
                    picked += np.split(own, cuts[1:])
                took = part.take(pa.array(at_query, pa.int64()))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(bound[at_query]), pa.array(buckets, pa.int64()), pa.array(picked, pa.list_(pa.int64()))], ["id", "vector", "bound", "bucket", "lists"])

    members = members.select("id", "vector", "list", F.floor(F.col("list") / per_bucket).cast("long").alias("bucket"))
    probes = queries.where(F.size("vector") == size).mapInArrow(probe, "id long, vector array<double>, bound double, bucket long, lists array<long>") if rows else None
    others = [r for r in kinds if r.wide or r.size != size]
    if others:  # buckets of their own, below zero: a length's vectors, and its wide ones
        apart = -1 - (2 * F.size("vector") + F.col("wide").cast("long"))
        members = members.unionByName(vectors.where(F.col("wide") | (F.size("vector") != size)).select("id", "vector", apart.alias("list"), apart.alias("bucket")))
        codes = F.array(*[F.struct(F.lit(r.size).alias("size"), F.lit(-1 - (2 * r.size + int(r.wide))).cast("long").alias("bucket")) for r in others])
        asking = queries.withColumn("c", F.explode(F.filter(codes, lambda c: c["size"] == F.size("vector")))).select("id", "vector", F.lit(float("-inf")).alias("bound"), F.col("c.bucket").alias("bucket"), F.array("c.bucket").alias("lists"))
        probes = probes.unionByName(asking) if probes is not None else asking
    probes = durable(probes)
    asked = {r[0]: r[1] for r in probes.groupBy("bucket").count().collect()}  # a row a bucket at most
    held = dict(enumerate(full.tolist())) | {-1 - (2 * r.size + int(r.wide)): r.rows for r in others}
    chunks = spark.createDataFrame([(b, int(-(-n // chunk_rows) or 1), int(-(-asked.get(b, 0) // query_rows) or 1)) for b, n in held.items()], "bucket long, v int, q int")
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(F.broadcast(chunks), "bucket").select("bucket", F.pmod(F.xxhash64("id", "vector"), "v").cast("int").alias("v"), places("q").alias("q"), "id", "vector", "list")
    right = probes.join(F.broadcast(chunks), "bucket").select("bucket", places("v").alias("v"), F.pmod(F.xxhash64("id", "vector"), "q").cast("int").alias("q"), "id", "vector", "bound", "lists")
    names = ["query_id", "vec_id", "score"]

    def answer(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if vs.num_rows and qs.num_rows:
            matrix, ids, of = _matrix(vs["vector"]), vs["id"].to_numpy(), vs["list"].to_numpy()
            asking, points, bound, selected = qs["id"].to_numpy(), _matrix(qs["vector"]), qs["bound"].to_numpy(), qs["lists"].combine_chunks()
            who, what = selected.value_parent_indices().to_numpy(), selected.flatten().to_numpy()
            by_vector, by_query = np.argsort(of, kind="stable"), np.argsort(what, kind="stable")
            # rough scores in single precision, as far below the true ones as their rounding can be
            with np.errstate(over="ignore"):
                lengths = (points**2).sum(axis=1)
            rough, slack = (np.float32, 1.2e-7 * (matrix.shape[1] + 8)) if 1e-20 < min(most, lengths.min()) and max(most, lengths.max()) < 1e30 else (np.float64, 1e-9)
            rough_matrix, rough_points = matrix.astype(rough, copy=False), points.astype(rough, copy=False)
            least = bound - slack * np.sqrt(most) * np.sqrt(lengths)
            for one in np.intersect1d(of, what):
                own = by_vector[np.searchsorted(of[by_vector], one) : np.searchsorted(of[by_vector], one, "right")]
                asked = who[by_query[np.searchsorted(what[by_query], one) : np.searchsorted(what[by_query], one, "right")]]
                for at in range(0, len(asked), max(1, (1 << 20) // len(own))):
                    some = asked[at : at + max(1, (1 << 20) // len(own))]
                    fits = asking[some][:, None] != ids[own][None]
                    if one >= 0:  # exact scores decide among what may be among the best
                        with np.errstate(over="ignore", invalid="ignore"):
                            fits &= ~(rough_points[some] @ rough_matrix[own].T < least[some][:, None])
                    q, v = np.nonzero(fits)
                    score = _scores(points[some][q], matrix[own][v])
                    real = ~np.isnan(score)
                    out.append(_best(asking[some][q][real], ids[own][v][real], score[real], k))
        query, found, score = _best(*(np.concatenate(x) for x in zip(*out)), k)
        return pa.table([pa.array(query), pa.array(found), pa.array(score)], names)

    keys = ["bucket", "v", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query_id long, vec_id long, score double")
    if rows:
        found = found.unionByName(queries.where(F.size("vector") == size).mapInArrow(from_sample, "query_id long, vec_id long, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, an id once, by its best score."""
    order = np.lexsort((-score, found, query))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(query[order]) != 0) | (np.diff(found[order]) != 0)
    order = order[fresh]
    order = order[np.lexsort((found[order], -score[order], query[order]))]
    order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
    return query[order], found[order], score[order]
