"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The forest is fitted on a bounded sample (``SAMPLE`` rows by a hash of their vector) on the driver; every
row is indexed, in every tree. Inner products become angles-free distances by one more component,
sqrt(M^2 - |x|^2) with M the largest norm, which a query has as 0. A query walks all trees at once
through one priority queue of branches, ordered by the sum of the margins that their path crosses, until
the leaves met hold a budget of the sample's entries. Only rows of met leaves are candidates; each is scored once,
exactly, in double precision. The budget is what walks of ``TRIALS`` sampled rows need to meet ``TARGET`` of their
nearest rows in the sample; nearest rows of a larger table lie closer, so recall there is higher. With a target
of 1 walks go on to the end.

Equal vectors are indexed once, with their ``k + 1`` smallest distinct ids, each at most k times: ties
go to smaller ids, so no other row of them can be among the k nearest of any query. Queries with equal
vectors are searched once. Rows are dealt out in ``BLOCK``s by a hash and queries in ``CHUNK``s; a task has
a block and a chunk, and gives the best of the block for each query, up to k + 1 distinct ids with at
most k rows each. So no task holds more than a block and a chunk, and leaves are never gathered.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as
queries or candidates; components that a shorter vector lacks count as zero. With fewer than k
candidates all are given. Repeated ids are rows of their own; only rows with the query's id are not
its candidates. Null ids are candidates that come last in ties, never queries. An empty table gives no
row. Extra columns are ignored; there are no texts.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 20_000
TREES = 32
LEAF = 20  # sampled rows in a leaf, at most
TRIALS = 96
TARGET = 0.95
BLOCK = 25_000  # rows in a task
CHUNK = 8_000  # queries in a task
K = 20


@dataclass
class Forest:
    """Node arrays of all trees; children below 0 are leaves, ``-1 - leaf``."""

    normal: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # nodes x 2
    roots: list[int]
    leaves: int
    bound: float
    sizes: list[int]  # sampled rows of each leaf

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.bound - (x * x).sum(axis=1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        x, out = self.augmented(x), np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = (np.einsum("ij,ij->i", x[inner], self.normal[at]) > self.cut[at]).astype(int)
                node[inner] = self.child[at, side]
            out[:, t] = -1 - node
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of the summed margins that the paths to them cross."""
        margins = self.normal[:, : len(query)] @ query - self.cut
        right = (margins > 0).astype(np.int64)
        rows = np.arange(len(margins))
        near, far = self.child[rows, right].tolist(), self.child[rows, 1 - right].tolist()
        margins = np.abs(margins).tolist()
        queue = [(0.0, n) for n in self.roots]
        heapq.heapify(queue)
        while queue:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                heapq.heappush(queue, (cost + margins[node], far[node]))
                node = near[node]
            yield -1 - node

    def met(self, query: np.ndarray, budget: float) -> np.ndarray:
        """A bit for each leaf: those met first, with ``budget`` sampled entries."""
        out, held = np.zeros(self.leaves, bool), 0
        for leaf in self.walk(query):
            out[leaf] = True
            held += self.sizes[leaf]
            if held >= budget:
                break
        return np.packbits(out)


def calibrate(forest: Forest, sample: np.ndarray, k: int, trials: int = TRIALS, target: float = TARGET, seed: int = 5) -> float:
    """Sampled entries that walks have to meet so that ``target`` of the k nearest sampled rows are among them."""
    if len(sample) < 2:
        return np.inf
    leaf, needed = forest.assign(sample), []
    for i in np.random.default_rng(seed).permutation(len(sample))[:trials]:
        score = sample @ sample[i]
        score[i] = -np.inf
        wanted = set(np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)].tolist())
        homes: dict[int, list[int]] = {}
        for r in wanted:
            for x in leaf[r].tolist():
                homes.setdefault(x, []).append(r)
        held = 0
        for x in forest.walk(sample[i]):
            held += forest.sizes[x]
            for r in homes.get(x, ()):
                if r in wanted:
                    wanted.remove(r)
                    needed.append(held)
            if not wanted:
                break
    return float(np.quantile(needed, target, method="higher"))


def fit_forest(sample: np.ndarray, bound: float, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((0, sample.shape[1] + 1)), np.zeros(0), np.zeros((0, 2), int), [], 0, bound, [])
    points = forest.augmented(sample)
    normals, cuts, children = [], [], []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(3):
                direction = rng.standard_normal(points.shape[1]) if len(rows) < 2 else points[rng.choice(rows)] - points[rng.choice(rows)]
                size = np.linalg.norm(direction)
                if size > 0:
                    direction = direction / size
                    along = points[rows] @ direction
                    cut = float(np.median(along))
                    right = along > cut
                    if 0 < right.sum() < len(rows):
                        at = len(normals)
                        normals.append(direction)
                        cuts.append(cut)
                        children.append([0, 0])
                        children[at] = [grow(rows[~right]), grow(rows[right])]
                        return at
        leaves += 1
        forest.sizes.append(len(rows))
        return -leaves

    forest.roots = [grow(np.arange(len(points))) for _ in range(trees)]
    forest.normal = np.array(normals).reshape(-1, points.shape[1])
    forest.cut, forest.child, forest.leaves = np.array(cuts), np.array(children, int).reshape(-1, 2), leaves
    return forest


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = K, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row for which ``is_query`` (on ``id``)."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    dims = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if dims is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v"))))
    # distinct vectors with their least k + 1 ids, each at most k times; ids are cut in two steps, so that a common vector gathers few
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    counted = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"), F.max(F.when(is_query, True).otherwise(False)).alias("asks"))
    numbered = counted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("one", F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    held = numbered.groupBy("v", "salt").agg(least(F.collect_list("one")).alias("ids"), F.max("asks").alias("asks"))
    held = held.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("asks").alias("asks"))
    held = held.withColumn("ids", F.flatten(F.transform("ids", lambda x: F.array_repeat(x["id"], x["n"]))))
    distinct = materialize(held.withColumn("vid", F.monotonically_increasing_id()), "ann-vectors")
    total, asking, bound = distinct.agg(F.count("*"), F.count_if("asks"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    part = min(1.0, 1.2 * sample / total)
    picked = distinct.where(F.xxhash64(F.lit("ann"), "v").bitwiseAND(F.lit(0xFFFFFF)) < part * 0x1000000).select("v").limit(sample)
    points = _matrix(picked.toPandas()["v"]) if total else np.zeros((0, dims))
    points = points[np.lexsort(points.T)] if len(points) else points
    points = points.reshape(-1, dims)
    forest = fit_forest(points, float(bound))
    # enough entries for k + 1 rows of their own whatever the trees share; small tables and a target of 1 are walked to the end
    budget = np.inf if target >= 1 or total <= 2 * (k + 1) else max(calibrate(forest, points, k, target=target), 2 * (k + 1) * len(forest.roots))
    shared = spark.sparkContext.broadcast(forest)  # about 3 nodes for each sampled row and ten trees

    def leaves_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf = shared.value.assign(_matrix(pdf["v"]))
                yield pd.DataFrame({"vid": pdf["vid"], "ids": pdf["ids"], "v": pdf["v"], "asks": pdf["asks"], "leaf": [x.tobytes() for x in leaf]})

    index = "vid long, ids array<long>, v array<double>, asks boolean, leaf binary"
    indexed = materialize(distinct.select("vid", "ids", "v", "asks").mapInPandas(leaves_of, index), "ann-index")
    blocks, chunks = -(-total // BLOCK), max(1, -(-asking // CHUNK))
    mixed = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                own = pdf.iloc[i : i + CHUNK]
                yield own.assign(met=[shared.value.met(np.asarray(q), budget).tobytes() for q in own["q"]])

    tasks = max(blocks * chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a number that is given is not merged: few rows, much work
    members = indexed.select("vid", "ids", "v", "leaf", mixed("block", blocks).alias("block"), each(chunks).alias("chunk"))
    asked = indexed.where("asks").select(F.col("vid").alias("qid"), F.col("v").alias("q"), mixed("chunk", chunks).alias("chunk")).repartition(tasks, "qid")
    asked = asked.mapInPandas(walked, "qid long, q array<double>, chunk int, met binary").withColumn("block", each(blocks))

    def nearest(x: np.ndarray, q: np.ndarray, near: np.ndarray, first: np.ndarray, ids: list) -> list[tuple]:
        """(score, row) of the best rows in ``near``: k + 1 distinct first ids, at most k rows of an id."""
        s = (x[near] * q).sum(axis=1)  # the same order of terms for each pair
        most = 4 * (k + 1)
        while True:
            best = np.flatnonzero(s >= -np.partition(-s, most)[most]) if len(s) > most else np.arange(len(s))
            out, seen, firsts = [], Counter(), set()
            for j in best[np.lexsort((first[near[best]], -s[best]))]:
                i = near[j]
                if len(firsts) > k:  # without the query's own id, k rows come before all others
                    return out
                firsts.add(first[i])
                if any(seen[n] < k for n in ids[i]):
                    out.append((float(s[j]), i))
                    seen.update(ids[i])
            if len(best) == len(s):
                return out
            most *= 8

    def score(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(own):
            x, vids, ids = _matrix(own["v"]), own["vid"].to_numpy(), own["ids"].tolist()
            first = np.array([min((i for i in o if i is not None), default=np.iinfo(np.int64).max) for o in ids])
            leaf = np.frombuffer(b"".join(own["leaf"]), np.int32)
            by_leaf = np.argsort(leaf, kind="stable")  # the block's rows by leaf, of all trees
            start = np.searchsorted(leaf[by_leaf], np.arange(shared.value.leaves + 1))
            row_of, size = by_leaf // (len(leaf) // len(own)), np.diff(start)
            seen = np.zeros(len(x), bool)
            for qid, q, bits in zip(asking["qid"], asking["q"], asking["met"]):
                held = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(size)))
                n = size[held]
                seen[:] = False
                seen[row_of[np.repeat(start[held] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
                near = np.flatnonzero(seen)
                if len(near):
                    out += [(qid, vids[r], s, ids[r]) for s, r in nearest(x, np.asarray(q), near, first, ids)]
        return pd.DataFrame(out, columns=["qid", "vid", "score", "ids"])

    dealt = lambda df: df.repartition(tasks, "block", "chunk").groupBy("block", "chunk")
    best = dealt(asked).cogroup(dealt(members)).applyInPandas(score, "qid long, vid long, score double, ids array<long>")
    # at most k rows of an id, then k + 1 ids by their best rows: whichever id is the query's, k rows of others are left
    by_id = best.select("qid", (-F.col("score")).alias("minus"), F.explode("ids").alias("id")).groupBy("qid", "id").agg(F.slice(F.array_sort(F.collect_list("minus")), 1, k).alias("all"))
    order = F.struct(F.col("all")[0].alias("minus"), F.coalesce("id", F.lit(2**63 - 1)).alias("key"), "id", "all")
    merged = by_id.groupBy("qid", F.pmod(F.xxhash64("id"), F.lit(8)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("near"))
    merged = merged.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    flat = merged.select("qid", F.array_sort(F.flatten(F.transform("near", lambda n: F.transform(n["all"], lambda m: F.struct(m.alias("minus"), n["key"].alias("key"), n["id"].alias("id")))))).alias("near"))
    queries = materialize(rows.where(is_query).where("id is not null").select("id", "v"), "ann-queries")
    named = queries.join(distinct.where("asks").select("v", F.col("vid").alias("qid")), "v").select("id", "qid")
    own = named.join(flat, "qid").select("id", F.slice(F.filter("near", lambda n: ~n["id"].eqNullSafe(F.col("id"))), 1, k).alias("near"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("near").alias("pos", "n")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.minus")).alias("score"))
