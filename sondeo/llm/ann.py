"""Approximate nearest neighbours (operator 5): balanced posting lists over a centroid graph.

Largest inner products are nearest neighbours on the sphere once every vector gets one more component,
sqrt(M^2 - |x|^2) with M the largest norm. A sample of at most ``SAMPLE`` vectors is halved
at medians until lists hold about ``LIST_ROWS`` vectors, so the lists are balanced; their means are the
centroids (at most ``MAX_LISTS``, sent to every task). Each vector goes to its nearest list and, near a
border, to up to ``REPLICAS`` of them. Queries walk a neighbour graph of the centroids with a beam and read
the lists whose distance is within a ratio of the best, and further ones until they hold k answers. Beam, ratio and number of
lists read start at ``BEAM``, ``PRUNE`` and ``MAX_PROBES`` and grow until the recall of a sample of at most ``TRIALS``
queries, compared with all vectors, is at least ``RECALL``; the last step reads every list. Lists are cut into parts, each
query meets each part of its lists once, and scores are exact double-precision inner products.

Equal vectors are indexed once with their K + 1 smallest ids: no query can rank more of them, so
one vector held by a third of the rows costs what one row costs. Vectors that are NULL, zero, of
another length than most, or hold NULL or non-finite components take no part; an empty table gives
no rows; repeated rows (same vec_id and vector) count once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save

K = 20
SAMPLE = 20_000
LIST_ROWS = 150
MAX_LISTS = 4096
REPLICAS = 4
BORDER = 1.12  # a vector joins lists up to this ratio of its smallest distance
PRUNE = 1.30  # PRUNE, MAX_PROBES and BEAM are the first step; later steps widen them until RECALL is met
MAX_PROBES = 96
DEGREE = 24
BEAM = 128
TRIALS = 256  # queries whose recall is measured
RECALL = 0.93  # 0.9 is asked for; the rest covers the error of the sample
PART_ROWS = 2_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1)
    return rows.join(F.broadcast(sizes.select("d")), F.size("v") == F.col("d")).select("vec_id", "v").distinct()


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1) / longest


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` groups of equal size: the largest group is halved at the median between two far means."""
    rng = np.random.default_rng(5)
    heap, parts = [(-len(x), 0)], {0: np.arange(len(x))}
    while len(parts) < lists:
        n, k = heapq.heappop(heap)
        if -n < 2:
            heapq.heappush(heap, (n, k))
            break
        rows = parts.pop(k)
        y = x[rows]
        a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
        for _ in range(6):
            side = ((y - a) ** 2).sum(axis=1) < ((y - b) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            a, b = y[side].mean(axis=0), y[~side].mean(axis=0)
        order = np.argsort(y @ (b - a), kind="stable")
        half = len(rows) // 2
        for name, chosen in ((2 * k + 1, order[:half]), (2 * k + 2, order[half:])):
            parts[name] = rows[chosen]
            heapq.heappush(heap, (-len(chosen), name))
    return np.stack([x[r].mean(axis=0) for r in parts.values()]) if len(x) else np.zeros((0, x.shape[1]))


def centroid_graph(c: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones, and two drawn at random so that the graph hangs together."""
    n = len(c)
    d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if n <= 256 else np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * c @ c.T, 0)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1]
    return np.concatenate([near, np.random.default_rng(3).integers(0, n, (n, 2))], axis=1)


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Beam search over the centroid graph: centroids found and their distances, nearest first. A beam of half the
    centroids or more ranks them all."""
    if 2 * beam >= len(c):
        d = np.sqrt(((c - q) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")
        return near, d[near]
    seen = np.zeros(len(c), bool)
    start = np.unique(np.linspace(0, len(c) - 1, 8).astype(np.int64))
    seen[start] = True
    todo = [(float(d), int(i)) for i, d in zip(start, np.sqrt(((c[start] - q) ** 2).sum(axis=1)), strict=True)]
    best = [(-d, -i) for d, i in todo]  # at most ``beam`` centroids, the farthest first
    heapq.heapify(best)
    heapq.heapify(todo)
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) == beam and d > -best[0][0]:
            break
        fresh = np.unique(graph[i][~seen[graph[i]]])
        if len(fresh):
            seen[fresh] = True
            for j, e in zip(fresh.tolist(), np.sqrt(((c[fresh] - q) ** 2).sum(axis=1)).tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (-e, -j))
                elif e <= -best[0][0]:
                    heapq.heappushpop(best, (-e, -j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
    found = sorted((-d, -i) for d, i in best)
    return np.array([i for _, i in found]), np.array([d for d, _ in found])


def steps(lists: int) -> list[tuple[int, float, int]]:
    """(lists read at most, distance ratio, beam) of each step; the last reads all lists."""
    out, probes, ratio, beam = [], MAX_PROBES, PRUNE, BEAM
    while probes < lists:
        out.append((probes, ratio, beam))
        probes, ratio, beam = 2 * probes, 1.15 * ratio, 2 * beam
    # Where all lists are few enough to be read, the ratio alone still prunes.
    return [*out, *([] if out else [(lists, PRUNE, lists), (lists, 1.5 * PRUNE, lists)]), (lists, float("inf"), lists)]


def to_read(q: np.ndarray, c: np.ndarray, graph: np.ndarray, rows: np.ndarray, need: int, step: tuple[int, float, int]) -> np.ndarray:
    """Lists that a query reads: those of the step, and further ones until they hold ``need`` vectors. ``rows`` are the
    vectors of each list that are nearest to it, so none counts twice."""
    probes, ratio, beam = step
    near, dist = walk(q, c, graph, beam)
    n = int(min(probes, (dist <= ratio * dist[0] + 1e-12).sum()))
    if rows[near[:n]].sum() < need:
        if rows[near].sum() < need:
            near, _ = walk(q, c, graph, len(c))
        n = max(n, int(np.searchsorted(np.cumsum(rows[near]), need)) + 1)
    return near[:n]


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All products in double precision, summed in component order: equal vectors get equal scores."""
    out = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        out += q[:, k, None] * v[None, :, k]
    return out


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def query_points(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x / np.sqrt((x**2).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))], axis=1)


def enough_probes(points: DataFrame, distinct: DataFrame, postings: DataFrame, cents: np.ndarray, graph: np.ndarray, own_rows: np.ndarray, k: int, need: int) -> tuple[int, float, int]:
    """The first step whose recall on a sample of the query points (vkey, v) is at least RECALL. Their true answers come
    from all vectors; each task hands on k + 1 of them for each query of the sample."""
    ladder = steps(len(cents))
    trial = points.orderBy(F.xxhash64("vkey"), "vkey").limit(TRIALS).collect()
    if len(cents) == 1 or not trial:
        return ladder[-1]
    keys, x = np.array([r["vkey"] for r in trial], np.int64), np.array([r["v"] for r in trial])

    def best_of_task(batches):
        score, who = np.full((len(x), k + 1), -np.inf), np.zeros((len(x), k + 1), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                b = batch.slice(lo, 4000)
                ids = b.column("vkey").to_numpy(zero_copy_only=False)
                s = np.concatenate([score, x @ _matrix(b.column("v")).T], axis=1)
                w = np.concatenate([who, np.broadcast_to(ids, (len(x), len(ids)))], axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                score, who = np.take_along_axis(s, top, axis=1), np.take_along_axis(w, top, axis=1)
        q, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(who[q, j]), pa.array(score[q, j])], ["qkey", "vkey", "score"])

    found = distinct.select("vkey", "v").mapInArrow(best_of_task, "qkey long, vkey long, score double").where("qkey <> vkey")
    order = W.partitionBy("qkey").orderBy(F.col("score").desc(), "vkey")
    truth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("qkey", "vkey")
    places = postings.select("vkey", "list").join(F.broadcast(truth), "vkey").groupBy("qkey", "vkey").agg(F.collect_list("list").alias("lists"))
    answers: dict[int, list[list[int]]] = {}
    for r in places.collect():  # at most TRIALS * k rows of REPLICAS numbers
        answers.setdefault(r["qkey"], []).append(r["lists"])
    q = query_points(x)
    for step in ladder[:-1]:
        hits = total = 0
        for key, point in zip(keys.tolist(), q, strict=True):
            read = np.zeros(len(cents), bool)
            read[to_read(point, cents, graph, own_rows, need, step)] = True
            hits += sum(bool(read[a].any()) for a in answers.get(key, []))
            total += len(answers.get(key, []))
        if hits >= RECALL * total:
            return step
    return ladder[-1]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest found for each query row: query_id, rank, vec_id, score. ``queries`` are rows of ``vectors``."""
    spark = vectors.sparkSession
    rows = save(usable(vectors).withColumn("h", F.xxhash64("v")), "vectors")
    first = W.partitionBy("h", "v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    distinct = save(few.groupBy("h", "v").agg(F.min("vec_id").alias("vkey"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    total = distinct.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    longest = float(distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).head()[0]) ** 0.5
    lists = int(min(MAX_LISTS, max(1, total // LIST_ROWS)))
    sample = distinct.orderBy(F.xxhash64("h"), "vkey").limit(SAMPLE).select("v").collect()
    cents = balanced_centroids(augment(np.array([r["v"] for r in sample]), longest), lists)
    lists = len(cents)
    graph = centroid_graph(cents) if lists > 1 else np.zeros((1, 1), np.int64)

    def post(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                x = augment(_matrix(b.column("v")), longest)
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (cents**2).sum(1)[None] - 2 * x @ cents.T, 0))
                m = min(REPLICAS, lists)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                dist = np.take_along_axis(d, near, axis=1)
                keep = dist <= BORDER * dist.min(axis=1, keepdims=True) + 1e-12
                row, col = np.nonzero(keep)
                own = col == dist.argmin(axis=1)[row]
                yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int32)), b.column("vkey").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(own)], ["list", "vkey", "v", "own"])

    def probe(batches):
        for batch in batches:
            q = query_points(_matrix(batch.column("v")))
            found, owner = [], []
            for i in range(len(q)):
                near = to_read(q[i], cents, graph, own_rows, need, step)
                found.append(near)
                owner.append(np.full(len(near), i))
            at = pa.array(np.concatenate(owner)) if owner else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) if found else np.zeros(0)).astype(np.int32)), batch.column("vkey").take(at), batch.column("v").take(at)], ["list", "qkey", "q"])

    postings = save(distinct.select("vkey", "v").mapInArrow(post, "list int, vkey long, v array<double>, own boolean"), "postings")
    counted = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"), F.sum(F.col("own").cast("long")).alias("own"))
    counts = counted.collect()  # one row per list: at most MAX_LISTS
    sizes = {r["list"]: r["parts"] for r in counts}
    own_rows = np.zeros(lists, np.int64)
    for r in counts:
        own_rows[r["list"]] = r["own"]
    need = min(k + 1, total)
    parts_of = F.element_at(F.array(*[F.lit(sizes.get(i, 1)) for i in range(lists)]), F.col("list") + 1)
    members = postings.drop("own").withColumn("part", F.pmod(F.hash("vkey"), parts_of))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(rows, "vec_id")
    asked = save(asked.join(distinct.select("h", "v", "vkey"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey"), "v"), "asked")
    points = asked.select(F.col("qkey").alias("vkey"), "v").dropDuplicates(["vkey"])
    step = enough_probes(points, distinct, postings, cents, graph, own_rows, k, need)
    probes = points.mapInArrow(probe, "list int, qkey long, q array<double>")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1)))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qk, sc, vk = [], [], []
        if left.num_rows and right.num_rows:
            v = _matrix(left.column("v").combine_chunks())
            ids = left.column("vkey").to_numpy()
            order = np.argsort(ids, kind="stable")
            v, ids = v[order], ids[order]
            for lo in range(0, right.num_rows, 256):
                some = right.slice(lo, 256)
                s = inner_products(_matrix(some.column("q").combine_chunks()), v)
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                qk.append(np.repeat(some.column("qkey").to_numpy(), top.shape[1]))
                sc.append(np.take_along_axis(s, top, axis=1).ravel())
                vk.append(ids[top].ravel())
        cat = [np.concatenate(x) if x else np.zeros(0) for x in (qk, vk, sc)]
        return pa.Table.from_arrays([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.float64))], ["qkey", "vkey", "score"])

    partial = members.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInArrow(score, "qkey long, vkey long, score double")
    best = W.partitionBy("qkey").orderBy(F.col("score").desc(), "vkey")
    top = partial.dropDuplicates(["qkey", "vkey"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    with_ids = top.join(distinct.select("vkey", "ids"), "vkey").select("qkey", "score", F.explode("ids").alias("vec_id"))
    # Of a query vector's answers no more than k + 1 rows can be ranked by any of its rows.
    nearest = W.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    with_ids = with_ids.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).drop("r")
    joined = asked.select("query_id", "qkey").join(with_ids, "qkey").where("vec_id <> query_id")
    ranked = joined.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
