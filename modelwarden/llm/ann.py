"""Approximate nearest neighbours by largest inner product, over a hierarchical k-means tree.

Equal vectors are folded into one first, with the smallest vec_ids that an answer could need, so a vector that many rows
share is one candidate and one query. The tree is fitted on a bounded sample; every vector is then dealt to a leaf. A
query walks the tree best bin first: a priority queue holds nodes by an optimistic inner product (that with the
centroid, plus the query's length times the spread of the node), and the best node is opened next, until `visits`
leaves have come out and hold k rows besides the query's own, or no leaf is left. Visits are calibrated: sample queries are
answered by brute force over all vectors, in blocks, and visits widen until the leaves seen hold the wanted share of the true
neighbours.

Queries and vectors meet by leaf. A leaf with many vectors or many queries is cut into blocks, and each pair of blocks is a
task, so a crowded leaf is never one task; each gives back the best of its block only.

Defined results: vectors that are null, empty, all zero, hold a null or non-finite component or have another length than
most, and rows without vec_id, take no part; of several vectors under one vec_id the smallest counts; fewer candidates
than `k` give shorter answers; equal products go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwarden.session import materialise

#: Vectors that the tree is fitted on, and queries that calibrate the visits, at most.
SAMPLE, CALIBRATION = 20_000, 256
BRANCHES = 8
BLOCK = 4096
RECALL = 0.94
HIT = "array<struct<score:double,vec_id:bigint>>"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles), one per vec_id, of the rows that take part."""
    infinity = float("inf")
    fit = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
           & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
           & F.exists("embedding", lambda x: x != 0))
    named = rows.where(fit).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                   F.col("embedding").cast("array<double>").alias("vector"))
    named = materialise(named.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    common = named.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return named.where(F.size("vector") == (common["n"] if common else 0))


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Tree:
    """Centroids, spreads and children of the nodes; node 0 is the root, leaves have no children."""

    def __init__(self, sample: np.ndarray, total: int):
        rng = np.random.default_rng(6)
        self.centroid, self.spread, self.children = [], [], []
        scale = total / max(1, len(sample))
        target = max(64.0, total**0.75 / 8)  # leaves grow slowly, as every query visits a share of them

        def grow(points: np.ndarray) -> int:
            at = len(self.centroid)
            middle = points.mean(axis=0) if len(points) else np.zeros(sample.shape[1])
            self.centroid.append(middle)
            self.spread.append(float(np.sqrt(((points - middle) ** 2).sum(axis=1).mean())) if len(points) else 0.0)
            self.children.append([])
            branches = min(BRANCHES, int(len(points) * scale / target + 0.5))
            if branches > 1 and len(points) >= 2 * branches:
                own = kmeans(points, branches, rng)
                if len(np.unique(own)) > 1:
                    self.children[at] = [grow(points[own == k]) for k in np.unique(own)]
            return at

        grow(sample)
        self.centroid, self.spread = np.array(self.centroid), np.array(self.spread)

    def deal(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root down, always the nearest centroid."""
        out = np.zeros(len(vectors), np.int64)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            at, own = stack.pop()
            below = self.children[at]
            if not below or not len(own):
                out[own] = at
                continue
            c = self.centroid[below]
            nearest = ((c**2).sum(axis=1)[None, :] - 2 * vectors[own] @ c.T).argmin(axis=1)
            stack += [(child, own[nearest == k]) for k, child in enumerate(below)]
        return out

    def visit(self, query: np.ndarray, visits: int, held: np.ndarray | None = None, needed: int = 0) -> list[int]:
        """The first `visits` leaves in best-bin-first order, and more until they hold `needed` rows (`held`: rows by node)."""
        hope = self.centroid @ query + np.linalg.norm(query) * self.spread / np.sqrt(len(query))
        queue, out, seen = [(-hope[0], 0)], [], 0
        while queue and (len(out) < visits or seen < needed):
            _, at = heapq.heappop(queue)
            if self.children[at]:
                for child in self.children[at]:
                    heapq.heappush(queue, (-hope[child], child))
            else:
                out.append(at)
                seen += held[at] if needed else 0
        return out

    def leaves(self) -> int:
        return sum(not c for c in self.children)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster of each point."""
    centers = points[rng.choice(len(points), k, replace=False)]
    own = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        new = ((centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T).argmin(axis=1)
        if (new == own).all():
            break
        own = new
        for c in range(k):
            if (own == c).any():
                centers[c] = points[own == c].mean(axis=0)
    return own


def best_rows(queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[list[dict]]:
    """For each query its k best rows among the vectors, each of which stands for the rows `ids`."""
    out = []
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        rough = part @ vectors.T
        for q, scores in zip(part, rough):
            if len(scores) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge)))
            else:
                near = np.arange(len(scores))
            exact = (vectors[near] * q).sum(axis=1)  # the same sum wherever the pair is met
            rows = sorted((-s, i) for s, n in zip(exact.tolist(), near) for i in ids[n])[:k]
            out.append([{"score": -s, "vec_id": i} for s, i in rows])
    return out


def merged(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, hits): the k best of all partial answers of a query."""
    order = lambda a, b: (F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                          .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    joined = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits"))), order)
    return df.groupBy(key).agg(F.slice(joined, 1, k).alias("hits"))


def calibrated_visits(tree: Tree, sample: np.ndarray, vectors: DataFrame, k: int, recall: float) -> int:
    """Leaf visits at which the sample queries' leaves hold `recall` of their true k nearest of all vectors."""
    if not len(sample):
        return 1
    shared = vectors.sparkSession.sparkContext.broadcast((tree, sample))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of all vectors of a task, for every sample query."""
        model, queries = shared.value
        scores, leaf = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            rows = stacked(batch.column("vector"))
            scores = np.hstack([scores, queries @ rows.T])
            leaf = np.hstack([leaf, np.broadcast_to(model.deal(rows), (len(queries), len(rows)))])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, leaf = np.take_along_axis(scores, top, 1), np.take_along_axis(leaf, top, 1)
        index = np.repeat(np.arange(len(queries), dtype=np.int32), scores.shape[1])
        yield pa.record_batch({"query": index, "score": scores.ravel(), "leaf": leaf.ravel()})

    def best(hits: DataFrame, *keys: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "leaf")))
        return hits.groupBy("query", *keys).agg(F.slice(order, 1, k).alias("top"))

    partial = vectors.select("vector").mapInArrow(brute, "query int, score double, leaf bigint")
    # Tasks' answers meet in up to 256 groups a query first, so one row gathers few of them.
    salted = best(partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(256))), "salt")
    again = salted.select("query", F.explode("top").alias("hit")).select("query", (-F.col("hit.s")).alias("score"), "hit.leaf")
    truth = best(again).select("query", F.col("top.leaf").alias("leaf")).collect()  # k leaf numbers a sample query
    rank = []
    for row in truth:
        at = {leaf: n for n, leaf in enumerate(tree.visit(sample[row["query"]], tree.leaves()))}
        rank += [at[x] for x in row["leaf"]]
    visits = 1
    while np.mean(np.array(rank) < visits) < recall:
        visits += max(1, visits // 8)
    return min(visits, tree.leaves())


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vec_id in `queries` its k nearest other rows found.

    `rows` has vec_id and embedding. `recall` is the share of true neighbours that calibration asks for.
    """
    spark = rows.sparkSession
    vectors = usable(rows)
    folded = vectors.groupBy("vector").agg(F.min("vec_id").alias("key"), F.count("*").alias("n"))
    folded = materialise(folded, "folded")
    keyed = materialise(vectors.join(folded, "vector").select("vec_id", "key"), "keys")
    # Answers have k rows besides the query itself, so of equal vectors the k + 1 smallest ids can matter.
    shared_ids = keyed.join(folded.where("n > 1").select("key"), "key")
    least = shared_ids.groupBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(
        F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    least = least.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    folded = folded.join(least, "key", "left").select("key", "vector", F.coalesce("ids", F.array("key")).alias("ids"))
    folded = materialise(folded, "folded")
    total = folded.count()
    order = F.xxhash64("key", F.lit(17))
    sample = stacked(folded.select("vector").orderBy(order).limit(SAMPLE).toArrow().column("vector"))
    asked = keyed.join(queries.select("vec_id").distinct(), "vec_id")
    probes = folded.join(asked.select("key").distinct(), "key").select("key", "vector")
    tree = Tree(sample, total)
    trial = stacked(probes.orderBy(order).limit(CALIBRATION).select("vector").toArrow().column("vector"))
    visits = calibrated_visits(tree, trial, folded, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.deal(stacked(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    members = materialise(folded.mapInArrow(place, "key bigint, vector array<double>, ids array<bigint>, leaf bigint"), "members")
    # A number per node; of equal vectors at most k + 1 rows are in `ids`, as many as an answer could need.
    held = np.zeros(len(tree.children), np.int64)
    for leaf, n in members.groupBy("leaf").agg(F.sum(F.size("ids"))).collect():
        held[leaf] = n
    sizes = spark.sparkContext.broadcast(held)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [shared.value.visit(q, visits, sizes.value, k + 1) for q in stacked(batch.column("vector"))]
            index = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
            leaf = np.array([x for p in paths for x in p], np.int64)
            taken = batch.take(pa.array(index))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf)], names=[*taken.schema.names, "leaf"])

    asks = materialise(probes.mapInArrow(walk, "key bigint, vector array<double>, leaf bigint"), "asks")
    # A row per leaf; the tree has no more leaves than the sample has vectors.
    blocks = members.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(block)).alias("m")).join(
        asks.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(block)).alias("q")), "leaf")
    blocks = F.broadcast(blocks)

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        return (df.join(blocks, "leaf").withColumn(f"at_{own}", F.pmod(F.xxhash64("key"), F.col(own)))
                .withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("m", "q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "hits": pa.array([], hit_type)})
        hits = best_rows(stacked(left.column("vector")), stacked(right.column("vector")),
                         right.column("ids").to_pylist(), k + 1)
        return pa.table({"key": left.column("key"), "hits": pa.array(hits, hit_type)})

    hit_type = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
    by = ["leaf", "at_m", "at_q"]
    found = spread(asks, "q", "m").groupBy(*by).cogroup(spread(members, "m", "q").groupBy(*by)).applyInArrow(
        search, f"key bigint, hits {HIT}")
    answers = materialise(merged(found, "key", k + 1), "answers")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return (asked.withColumnRenamed("vec_id", "query_id").join(answers, "key")
            .select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    F.col("hit.score").alias("score")))
