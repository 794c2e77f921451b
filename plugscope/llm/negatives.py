"""Hard negatives by exact search under bounds from an orthogonal PCA rotation.

Vectors become integers, floor(``SCALE`` x). A rotation, the eigenvectors of the second moments of a bounded
sample (``SAMPLE`` rows), moves most of an inner product into few leading components. For a block of rows
and the anchors of a tile, products of the leading components are one matrix product; what the others can
add is at most the product of both residual norms (Cauchy-Schwarz), plus ``SLACK`` times the norms for
rounding. Rows whose upper bound lies below what enough other rows surely reach are discarded, the rest
get more components, and what survives the last of ``STAGES`` is scored by int64 products. So results are exact.

Positives are an anchor's first rows of its own label; negatives of a positive are the first rows of other
labels whose score lies between ``low`` % of the positive's and it. Each is one pass over (block, chunk)
cells: rows are dealt out in ``BLOCK``s, anchors in ``CHUNK``s, a cell gives its best rows for each of its
anchors, and a window merges the cells'. Every row is sent once for each ``CHUNK`` anchors, little beside
the cell's products; nothing of unbounded size meets in a task, whatever the labels' or vectors' shares.

Edge cases: rows with a null label or vector, or with a null or non-finite component, take no part; neither
do vectors with a component so large that products could leave 64 bits (beyond sqrt(2^62 / dimensions)
after scaling). Components that a shorter vector lacks count as zero. Ties go to the smaller id, null ids
last. Repeated rows are rows of their own, also as anchors: only the row itself is no candidate. Null ids
are no anchors. With fewer rows than asked for, all are given. An empty table gives no rows. Extra columns
are ignored; there are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
SAMPLE = 20_000
STAGES = (8, 16, 32)
SLACK = 1e-9
BLOCK = 25_000
CHUNK = 4_096
TILE = 64


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns are orthonormal, the directions of largest second moment first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1]


class _Rows:
    """Rows of a cell: integers, their rotation, and residual norms after each stage."""

    def __init__(self, packed: pd.Series, turn: np.ndarray):
        d = len(turn)
        self.x = np.frombuffer(b"".join(packed), np.int64).reshape(-1, d)
        self.y = self.x @ turn
        self.norm = np.sqrt((self.y * self.y).sum(axis=1))
        self.tail = {c: np.sqrt((self.y[:, c:] ** 2).sum(axis=1)) for c in STAGES if c < d}

    def bounds(self, c: int, at: np.ndarray | slice, other: _Rows, one: np.ndarray | slice, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = np.multiply.outer(self.tail[c][at], other.tail[c][one]) + SLACK * np.multiply.outer(self.norm[at], other.norm[one]) + SLACK
        return partial - rest, partial + rest


def _surviving(rows: _Rows, anchors: _Rows, tile: np.ndarray, pool: np.ndarray, keep) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, rows of ``pool`` that may be among its best); ``keep(anchor, lower, upper)`` gives a mask."""
    stages = [c for c in STAGES if c < rows.y.shape[1]]
    if not stages or not len(pool):
        yield from ((j, pool) for j in tile)
        return
    c = stages[0]
    partial = rows.y[pool, :c] @ anchors.y[tile, :c].T
    lower, upper = rows.bounds(c, pool, anchors, tile, partial)
    for n, j in enumerate(tile):
        mask = keep(j, pool, lower[:, n], upper[:, n])
        alive, sums = pool[mask], partial[mask, n]
        for a, b in zip(stages, stages[1:]):
            sums = sums + rows.y[alive, a:b] @ anchors.y[j, a:b]
            low, high = rows.bounds(b, alive, anchors, j, sums)
            mask = keep(j, alive, low, high)
            alive, sums = alive[mask], sums[mask]
        yield j, alive


def _floor(lower: np.ndarray, k: int) -> float:
    """A value that k rows surely reach; minus infinity where there are not as many."""
    return float(np.partition(lower, -k)[-k]) if len(lower) >= k else -np.inf


def _best(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 8 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[np.lexsort((ids[near], none[near], -score[near]))[:k]]
    return np.lexsort((ids, none, -score))[:k]


def _numbers(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    none = ids.isna().to_numpy()
    return ids.astype("Int64").fillna(0).to_numpy(np.int64), none


def prepare(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, np.ndarray, int] | None:
    """Written rows (row, id, label, x: packed integers, asks, block), the rotation and the number of blocks; none for an empty table. ``is_anchor`` is a column of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(~odd)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return None
    dims = max(dims, 1)
    most = isqrt((1 << 62) // dims)
    rows = rows.where(~F.exists("v", lambda x: F.abs(x) * SCALE > most))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                x = np.zeros(dims, np.int64)
                x[: len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
                out.append(x.tobytes())
            yield pdf[["row", "id", "label", "asks"]].assign(x=out)

    packed = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(pack, "row long, id long, label long, asks boolean, x binary")
    kept = materialize(packed, "negatives-rows")
    total = kept.count()
    if not total:
        return None
    part = min(1.0, 1.2 * SAMPLE / total)
    picked = kept.where(F.pmod(F.xxhash64(F.lit("pca"), "row"), F.lit(1 << 24)) < part * (1 << 24)).select("x").limit(SAMPLE).toPandas()["x"]
    sample = np.frombuffer(b"".join(picked), np.int64).reshape(-1, dims).astype(np.float64)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-total // BLOCK), min(parts, -(-total // 2000)))
    return kept.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), rotation(sample), blocks


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor's positives."""
    spark = vectors.sparkSession
    made = prepare(vectors, is_anchor, id_col, vector_col, label_col)
    if made is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, turn, blocks = made
    asked = rows.where("asks").where("id is not null").drop("asks", "block")
    chunks = max(1, -(-asked.count() // CHUNK))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "row"), F.lit(chunks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = max(blocks * chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = rows.select("row", "id", "label", "x", "block", each(chunks).alias("chunk")).repartition(tasks, "block", "chunk").groupBy("block", "chunk")
    dealt = lambda df: df.withColumn("chunk", chunk).withColumn("block", each(blocks)).repartition(tasks, "block", "chunk").groupBy("block", "chunk")

    def first_positives(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(own):
            held, anchors = _Rows(own["x"], turn), _Rows(asking["x"], turn)
            ids, none = _numbers(own["id"])
            row, label, arow, alabel = (f[c].to_numpy() for f in (own, asking) for c in ("row", "label"))
            for one in np.unique(alabel):
                pool, mine_ = np.flatnonzero(label == one), np.flatnonzero(alabel == one)

                def keep(j: int, at: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                    other = row[at] != arow[j]
                    return other & (upper >= _floor(lower[other], positives))

                for t in range(0, len(mine_), TILE):
                    for j, alive in _surviving(held, anchors, mine_[t : t + TILE], pool, keep):
                        alive = alive[row[alive] != arow[j]]
                        score = held.x[alive] @ anchors.x[j]
                        for n in _best(score, ids[alive], none[alive], positives):
                            r = alive[n]
                            out.append((arow[j], row[r], None if none[r] else ids[r], score[n]))
        return pd.DataFrame(out, columns=["arow", "prow", "positive_id", "positive_score"]).astype({"positive_id": "Int64"})

    order = lambda score, name: [F.desc(score), F.asc_nulls_last(name)]
    near = dealt(asked).cogroup(members).applyInPandas(first_positives, "arow long, prow long, positive_id long, positive_score long")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("arow").orderBy(*order("positive_score", "positive_id"), "prow"))).where(F.col("n") <= positives)
    near = materialize(near, "negatives-positives")
    wanted = near.groupBy("arow").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))  # at most ``positives``
    asked = materialize(asked.join(wanted.withColumnRenamed("arow", "row"), "row").select("row", "id", "label", "x", "scores"), "negatives-anchors")

    def first_negatives(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(own):
            held, anchors = _Rows(own["x"], turn), _Rows(asking["x"], turn)
            ids, none = _numbers(own["id"])
            label, alabel, arow = own["label"].to_numpy(), asking["label"].to_numpy(), asking["row"].to_numpy()
            spans = [[(-(-low * int(p) // 100), int(p)) for p in s if p >= 0] for s in asking["scores"]]  # a negative positive's span is empty

            def keep(j: int, at: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                mask = np.zeros(len(at), bool)
                other = label[at] != alabel[j]
                for least, most in spans[j]:
                    sure = other & (lower >= least) & (upper <= most)
                    mask |= (lower <= most) & (upper >= max(least, _floor(lower[sure], negatives)))
                return mask & other

            for one in np.unique(alabel):  # rows of the anchors' own label never meet them
                pool, mine_ = np.flatnonzero(label != one), np.flatnonzero(alabel == one)
                for t in range(0, len(mine_), TILE):
                    for j, alive in _surviving(held, anchors, mine_[t : t + TILE], pool, keep):
                        score = held.x[alive] @ anchors.x[j]
                        for least, most in spans[j]:
                            fit = np.flatnonzero((score >= least) & (score <= most))
                            for n in fit[_best(score[fit], ids[alive[fit]], none[alive[fit]], negatives)]:
                                r = alive[n]
                                out.append((arow[j], most, None if none[r] else ids[r], score[n]))
        return pd.DataFrame(out, columns=["arow", "positive_score", "negative_id", "negative_score"]).astype({"negative_id": "Int64"})

    found = dealt(asked).cogroup(members).applyInPandas(first_negatives, "arow long, positive_score long, negative_id long, negative_score long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("arow", "positive_score").orderBy(*order("negative_score", "negative_id")))).where(F.col("rank") <= negatives)
    named = near.join(asked.select(F.col("row").alias("arow"), F.col("id").alias("anchor_id")), "arow")
    return named.join(found, ["arow", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
