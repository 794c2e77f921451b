"""Ranked lexical search as a blocked sparse matrix product: item-term rows times term-document impacts.

Documents are read once and kept as rows of (term, frequency) in the shared folder; document frequencies
are counted over all of them. Items are taken in blocks of about ``PAIRS`` (item, term) pairs, so that a
block's rows, its terms and their weights have a bounded size and are broadcast. A task builds the term x
document matrix of each Arrow batch of documents (rows sorted by term, int64 impacts), adds the rows of an
item's terms up in one dense int64 row (Gustavson's order: row by row, in numpy), keeps the block's best
``k`` documents of each item over all its batches, and gives those; two windows merge the tasks' best.
One block is the rule: then only terms that an item holds are kept of documents. With more, documents are
still tokenized once, with all their terms, and every block reads what was written.

Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document
weight * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L. With ``once`` a term counts once
for an item, else as often as the item holds it.

Edge cases: a null text has no terms; documents without terms are not counted in N. Items that are null
or without terms give no rows. Repeated rows of either table are rows of their own (each repeated item is
ranked). Ties go to the smaller document id, null ids last. Very long texts are tokenized in pieces of
``PIECE`` bytes that end between terms. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 50
PAIRS = 1 << 20
PIECE = 1 << 20
SALTS = 16
#: ASCII letters in lower case, digits and all bytes beyond ASCII are parts of terms; the rest separates them.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter[bytes]:
    """Terms of a UTF-8 text with their frequencies."""
    flat, found, at = (text or b"").translate(_FLAT), Counter(), 0
    while at < len(flat):
        end = len(flat) if len(flat) - at <= PIECE else flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


def _terms(df: DataFrame, keep: str, wanted=None) -> DataFrame:
    """``keep`` (a long), n, terms, tfs of each row of (``keep``, text); of the terms only ``wanted`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value if wanted is not None else None
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py())
                n.append(found.total())
                own = [t for t in found if t in only] if only is not None else list(found)
                terms.append(own)
                tfs.append([found[t] for t in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))], names=[keep, "n", "terms", "tfs"])

    return df.mapInArrow(run, f"{keep} long, n long, terms array<binary>, tfs array<long>")


class _Product:
    """A block of items against batches of documents: the best ``k`` documents of each item so far."""

    def __init__(self, items: list[tuple[list[int], list[int]]], terms: list[bytes], weights: np.ndarray, docs: int, length: int, k: int):
        self.items, self.terms, self.weights = items, pa.array(terms, pa.binary()), weights
        self.docs, self.length, self.k = docs, length, k
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The batch's matrix by rows of terms: pointers, documents, impacts."""
        n, held = batch.column("n").to_pylist(), batch.column("terms")
        m = np.array([50 + 50 * x * self.docs // self.length for x in n], np.int64)
        at = np.repeat(np.arange(len(n)), np.diff(held.offsets.to_numpy()))
        tid = pc.fill_null(pc.index_in(held.flatten(), value_set=self.terms), -1).to_numpy()
        tf = batch.column("tfs").flatten().to_numpy()
        known = np.flatnonzero(tid >= 0)
        known = known[np.argsort(tid[known], kind="stable")]
        tid, tf, at = tid[known], tf[known], at[known]
        impact = self.weights[tid] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
        return np.searchsorted(tid, np.arange(len(self.weights) + 1)), at, impact

    def add(self, batch: pa.RecordBatch) -> None:
        start, at, impact = self.rows(batch)
        ids = batch.column(0)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, 0).to_numpy()
        for i, (terms, times) in enumerate(self.items):
            row = np.zeros(len(ids), np.int64)
            for t, x in zip(terms, times):
                a, b = start[t], start[t + 1]
                row[at[a:b]] += impact[a:b] * x  # a document occurs once among a term's
            near = np.flatnonzero(row > 0)
            if len(near) > self.k:
                least = np.partition(row[near], -self.k)[-self.k]
                near = near[row[near] >= least]
            if len(near):
                score, gone, own = (np.concatenate(p) for p in zip(self.best[i], (row[near], none[near], ids[near])))
                first = np.lexsort((own, gone, -score))[: self.k]
                self.best[i] = score[first], gone[first], own[first]


def rank(docs: DataFrame, items: DataFrame, k: int = K, once: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    asked = materialize(asked, "lexical-items")  # so that all later reads see the same row numbers
    asked = materialize(_terms(asked.select("row", "text"), "row").where(F.size("terms") > 0).join(asked.select("row", "item_id"), "row"), "lexical-item-terms")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0]
    if not pairs:
        return spark.createDataFrame([], schema)
    blocks = -(-pairs // PAIRS)
    of_block = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    only = None
    if blocks == 1:
        only = spark.sparkContext.broadcast({bytes(r["term"]) for r in asked.select(F.explode("terms").alias("term")).distinct().toLocalIterator()})
    kept = materialize(_terms(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary")), "id", only), "lexical-terms")
    count, length = kept.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not count:
        return spark.createDataFrame([], schema)
    held = kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if blocks > 1:
        held = materialize(held.join(asked.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi"), "lexical-frequencies")

    def search(block: int) -> DataFrame:
        own = of_block.where(F.col("block") == block)
        rows = own.select("row", "item_id", "terms", "tfs").collect()  # about PAIRS terms
        found = held.join(own.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi") if blocks > 1 else held
        df = {bytes(r["term"]): r["df"] for r in found.collect()}  # terms of the block
        terms = sorted(df)
        place = {t: i for i, t in enumerate(terms)}
        weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in terms], np.int64)
        lists = [([place[bytes(t)] for t in r["terms"] if bytes(t) in place], [1 if once else x for t, x in zip(r["terms"], r["tfs"]) if bytes(t) in place]) for r in rows]
        shared = spark.sparkContext.broadcast((lists, terms, weights, [r["row"] for r in rows], [r["item_id"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, terms, weights, row, item = shared.value
            product = _Product(lists, terms, weights, count, length, k)
            for batch in batches:
                product.add(batch)
            for i, (score, gone, ids) in enumerate(product.best):
                if len(score):
                    yield pa.RecordBatch.from_arrays([pa.array([row[i]] * len(ids), pa.int64()), pa.array([item[i]] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=gone), pa.array(score, pa.int64())], names=["row", "item_id", "doc_id", "score"])

        return kept.mapInArrow(run, "row long, item_id long, doc_id long, score long")

    best = search(0)
    for block in range(1, blocks):
        best = best.unionByName(search(block))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*order))).where(F.col("n") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
