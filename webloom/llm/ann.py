"""Nearest neighbours by inner product: an adaptive dimension scan in probed lists.

Vectors get one more coordinate that makes their norms equal, so that the
largest inner product is the smallest distance, and are rotated at random.  Each
goes to the list of its nearest centroid; lists lie side by side in blocks of
bounded size, stored by groups of columns.  A query scans the lists that its
number of probes names.  After each group of columns a hypothesis test on the
partial distance gives up candidates that are unlikely to come under the distance
of the k-th best so far; before any list is scanned, that is the k-th best of some
sampled vectors, which count as found, so that no query ends with fewer than k.
Queries go through a list side by side: while many candidates
are left, a group of columns is one matrix product, and then single pairs.
Survivors get the exact inner product of the original vectors.

A block of lists and the queries that probe it meet once; where many do, they are
dealt into pieces and the block goes to each.

The centroids, and the number of probes, are fitted on at most ``sample``
vectors in a fixed pseudorandom order; every vector is indexed.  Of equal
vectors only the k+1 smallest ids can be among k nearest, so no more are
scanned; equal queries are searched once.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, take no part; neither do vectors of another
dimension than the most frequent one.  Of rows with one id the smallest vector
counts.  Vectors are scaled by a power of two for the scan, so that squares
stay finite; products beyond the range of a double are infinite, and tie.  Ties go
to the smaller id.  With fewer candidates than k all are
returned.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sample_order, tune


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    k: int = 20
    query_every: int = 20
    sample: int = 20_000
    rounds: int = 8
    max_lists: int = 1024
    #: Vectors of one block, queries of one piece of work.
    block: int = 16_384
    queries: int = 4096
    #: Vectors of the sample that give each query its first limit.
    bound_sample: int = 2048
    #: Vectors and queries that are compared at once; below this share of them left, pairs are compared alone.
    chunk: int = 1024
    batch: int = 256
    dense: float = 0.01
    #: Recall that the number of probes is chosen for, on sampled queries.
    aim: float = 0.985
    trial_queries: int = 256
    #: Columns of a group, and the width of the test.
    columns: int = 16
    epsilon: float = 2.1
    seed: int = 11


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    norm: float  # the largest norm, squared
    scale: float  # a power of two; all but original vectors are multiplied by it
    probes: int
    some: np.ndarray  # sampled vectors, augmented and rotated
    some_rows: tuple[np.ndarray, np.ndarray]  # their ids and originals

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Where vectors lie."""
        return augmented(vectors * self.scale, self.norm) @ self.rotation

    def place_queries(self, queries: np.ndarray) -> np.ndarray:
        return np.concatenate([queries * self.scale, np.zeros((len(queries), 1))], 1) @ self.rotation


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, one row per id."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
    return found.groupBy("vec_id").agg(F.min("v").alias("v"))


def augmented(v: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm - (v * v).sum(1), 0))
    return np.concatenate([v, rest[:, None]], 1)


def nearest_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids."""
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * (x @ centroids.T)


def fit_index(ids: np.ndarray, sample: np.ndarray, total: int, norm: float, s: Settings, scale: float = 1.0) -> Index:
    """k-means on the sample; probes such that sampled queries find what they should.

    ``norm`` is of scaled vectors.
    """
    originals, sample = sample, sample * scale
    rng = np.random.default_rng(s.seed)
    dims = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    x = augmented(sample, norm) @ rotation
    lists = int(min(max(1, round(total**0.5)), s.max_lists, max(1, len(x) // 16)))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(s.rounds):
        own = np.concatenate([nearest_lists(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    own = np.concatenate([nearest_lists(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])
    trial = rng.choice(len(x), min(len(x), s.trial_queries), replace=False)
    q = np.concatenate([sample[trial], np.zeros((len(trial), 1))], 1) @ rotation
    scores = sample[trial] @ sample.T
    scores[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-scores, 1)[:, : s.k]
    place = nearest_lists(q, centroids).argsort(1).argsort(1)  # rank of each list for each query
    needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(s.aim * len(needed))))]) + 1 if len(needed) else lists
    return Index(rotation, centroids, norm, scale, min(lists, probes), x[: s.bound_sample], (ids[: s.bound_sample], originals[: s.bound_sample]))


def nearest_sampled(placed: np.ndarray, index: Index, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the k+1 nearest sampled vectors (fewer, if there are not so many) and their distances."""
    keep = min(s.k + 1, len(index.some))
    at, distance = np.empty((len(placed), keep), np.int64), np.empty((len(placed), keep))
    for lo in range(0, len(placed), s.batch):
        every = nearest_lists(placed[lo : lo + s.batch], index.some)
        best = np.argpartition(every, keep - 1, axis=1)[:, :keep]
        at[lo : lo + s.batch], distance[lo : lo + s.batch] = best, np.take_along_axis(every, best, 1)
    return at, distance


def first_limits(placed: np.ndarray, index: Index, s: Settings) -> np.ndarray:
    """For each query, a distance within which k+1 vectors lie."""
    return nearest_sampled(placed, index, s)[1].max(1) if len(index.some) > s.k else np.full(len(placed), np.inf)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return (x * y).sum(1)


def scan(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], index: Index, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k+1 best of a block for each query: (query number, vector id, exact inner product)."""
    order = np.argsort(lists, kind="stable")
    vectors, ids, lists = vectors[order], ids[order], lists[order]
    x, q = index.place(vectors), index.place_queries(queries)
    dims, keep = x.shape[1], s.k + 1
    groups = [(a, min(a + s.columns, dims)) for a in range(0, dims, s.columns)]
    columns = [np.ascontiguousarray(x[:, a:b]) for a, b in groups]
    sizes = [(c * c).sum(1) for c in columns]
    factors = [(1 + s.epsilon / np.sqrt(b)) ** 2 * b / dims if b < dims else 1.0 for _, b in groups]
    tolerance = 1e-9 * max(index.norm, 1e-300)
    limits = first_limits(q, index, s)
    best = np.full((len(q), keep), np.inf)
    asked_list = np.concatenate(probed) if len(probed) else np.empty(0, np.int64)
    asked_by = np.repeat(np.arange(len(probed)), [len(p) for p in probed])
    by_list = np.argsort(asked_list, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for number in np.unique(lists):
        first, last = np.searchsorted(lists, [number, number + 1])
        at = np.searchsorted(asked_list[by_list], [number, number + 1])
        asking = asked_by[by_list[at[0] : at[1]]]
        for start in range(first, last, s.chunk):
            here = slice(start, min(last, start + s.chunk))
            for lo in range(0, len(asking), s.batch):
                own = asking[lo : lo + s.batch]
                who, what, distance = survivors(columns, sizes, groups, factors, here, q[own], limits[own] + tolerance, s)
                if len(who):
                    # The nearest of these and of those before give the limit for what follows.
                    times = np.bincount(who, minlength=len(own))
                    padded = np.full((len(own), times.max()), np.inf)
                    padded[who, np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)] = distance
                    best[own] = np.partition(np.concatenate([best[own], padded], 1), keep - 1, axis=1)[:, :keep]
                    limits[own] = np.minimum(limits[own], best[own].max(1))
                    found.append((own[who], start + what, distance))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    who, what, distance = (np.concatenate(c) for c in zip(*found))
    near = distance <= limits[who] + tolerance
    who, what = who[near], what[near]
    exact = np.concatenate([products(vectors[what[lo : lo + 65_536]], queries[who[lo : lo + 65_536]]) for lo in range(0, len(who), 65_536)])
    order = np.lexsort((ids[what], -exact, who))
    who, what, exact = who[order], what[order], exact[order]
    times = np.bincount(who, minlength=len(q))
    top = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) < keep
    return who[top], ids[what[top]], exact[top]


def survivors(columns: list, sizes: list, groups: list, factors: list, here: slice, q: np.ndarray, limits: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance), by query, of the pairs that no test has given up."""
    partial = np.zeros((len(q), here.stop - here.start))
    who = what = None
    for (a, b), column, size, factor in zip(groups, columns, sizes, factors):
        part, own = column[here], q[:, a:b]
        if who is None:
            partial += size[here]
            partial += (own * own).sum(1)[:, None]
            partial -= 2 * (own @ part.T)
            alive = partial <= (limits * factor)[:, None]
            left = int(np.count_nonzero(alive))
            if b == q.shape[1] or left < s.dense * alive.size:
                who, what = np.nonzero(alive)
                distance = partial[who, what]
            elif left < alive.size:
                partial[~alive] = np.inf
        else:
            gap = part[what] - own[who]
            distance = distance + np.einsum("ij,ij->i", gap, gap)
            alive = distance <= limits[who] * factor
            who, what, distance = who[alive], what[alive], distance[alive]
    return who, what, distance


def search(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    tune(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = usable(rows)
    sizes = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    if sizes is None:
        return empty
    vectors = materialize(vectors.where(F.size("v") == sizes.n), "ann-vectors")
    copies = Window.partitionBy("v").orderBy("vec_id")
    scanned = materialize(vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= s.k + 1).select("vec_id", "v"), "ann-scanned")
    total = scanned.count()
    largest = scanned.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scale = 2.0 ** -int(np.clip(np.frexp(largest)[1], -1000, 1000))
    norm = scanned.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * F.lit(scale) * x * F.lit(scale)))).first()[0]
    sample = scanned.orderBy(sample_order(F.col("vec_id")), "vec_id").limit(s.sample).select("vec_id", "v").toArrow()
    index = fit_index(sample.column("vec_id").to_numpy(), np.array(sample.column("v").to_pylist(), np.float64), total, float(norm), s, scale)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def list_of(v: pd.Series) -> pd.Series:
        index = shared.value
        x = index.place(np.stack(v.to_list()).astype(np.float64))
        return pd.Series(nearest_lists(x, index.centroids).argmin(1).astype(np.int32))

    listed = materialize(scanned.withColumn("list", list_of("v")), "ann-lists")
    # One row per list, at most max_lists: lists side by side fill a block, a large list has several.
    counts = {r.list: r["count"] for r in listed.groupBy("list").count().collect()}
    block_of, parts, block, filled = np.full(len(index.centroids), -1), {}, 0, 0
    for number in sorted(counts):
        if filled and filled + counts[number] > s.block:
            block, filled = block + 1, 0
        block_of[number] = block
        filled += counts[number]
        parts[block] = max(1, -(-filled // s.block))

    @F.pandas_udf("array<struct<block: int, lists: array<int>>>")
    def targets_of(v: pd.Series) -> pd.Series:
        index = shared.value
        q = index.place_queries(np.stack(v.to_list()).astype(np.float64))
        out = []
        for row in nearest_lists(q, index.centroids).argsort(1, kind="stable")[:, : index.probes]:
            row = np.sort(row[block_of[row] >= 0])
            own = block_of[row]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
            out.append([{"block": int(own[a]), "lists": [int(n) for n in row[a:b]]} for a, b in zip(starts, [*starts[1:], len(own)])])
        return pd.Series(out)

    asked = vectors.where(F.col("vec_id") % s.query_every == 0)
    searched = asked.select("v").distinct().withColumn("target", F.explode(targets_of("v"))).select("v", "target.*")
    searched = materialize(searched, "ann-queries")
    asking = {r.block: r["count"] for r in searched.groupBy("block").count().collect()}  # one row per block
    plan = [(b, parts[b], max(1, -(-asking.get(b, 0) // s.queries))) for b in parts]
    numbered = [(int(n), int(b), parts[b], max(1, -(-asking.get(int(b), 0) // s.queries))) for n, b in enumerate(block_of) if b >= 0]
    # A row per list or block, so max_lists rows at most.
    lists = F.broadcast(spark.createDataFrame(numbered, "list int, block int, parts int, pieces int"))
    blocks = F.broadcast(spark.createDataFrame(plan, "block int, parts int, pieces int"))
    left = listed.join(lists, "list").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.col("parts")).cast("int"))
    left = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("block", "part", "piece", "list", "vec_id", "v")
    right = searched.join(blocks, "block").withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "v"), F.col("pieces")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "piece", "v", "lists")
    keys = ["block", "part", "piece"]
    dims = sizes.n

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def run(xs: pa.Table, qs: pa.Table) -> pa.Table:
        names, kinds = ["v", "vec_id", "score"], [pa.list_(pa.float64()), pa.int64(), pa.float64()]
        if not len(xs) or not len(qs):
            return pa.table([pa.array([], k) for k in kinds], names)
        x, asked = matrix(xs.column("v")), matrix(qs.column("v"))
        probed = [np.array(p, np.int64) for p in qs.column("lists").to_pylist()]
        who, ids, scores = scan(x, xs.column("vec_id").to_numpy(), xs.column("list").to_numpy(), asked, probed, shared.value, s)
        vs = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * dims, pa.int32()), pa.array(asked[who].ravel()))
        return pa.table([vs, pa.array(ids), pa.array(scores)], names)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "v array<double>, vec_id long, score double")

    @F.pandas_udf("array<struct<vec_id: bigint, score: double>>")
    def sampled_of(v: pd.Series) -> pd.Series:
        index = shared.value
        q = np.stack(v.to_list()).astype(np.float64)
        ids, originals = index.some_rows
        return pd.Series([[{"vec_id": int(ids[i]), "score": float(x)} for i, x in zip(at, products(originals[at], one[None]))] for one, at in zip(q, nearest_sampled(index.place_queries(q), index, s)[0])])

    sampled = asked.select("v").distinct().select("v", F.inline(sampled_of("v")))
    # A sampled vector that a scan has found too stands there twice, with the same place.
    top = Window.partitionBy("v").orderBy(F.col("score").desc(), "vec_id")
    found = found.union(sampled).withColumn("place", F.dense_rank().over(top)).where(F.col("place") <= s.k + 1)
    found = found.groupBy("v").agg(F.sort_array(F.collect_set(F.struct("place", "vec_id", "score"))).alias("found"))
    # Of k+1 neighbours of the vector, a query drops itself, or else the last.
    hits = asked.join(found, "v").select(F.col("vec_id").alias("query_id"), F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")).alias("found"))
    hits = hits.select("query_id", F.posexplode(F.slice("found", 1, s.k)).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
