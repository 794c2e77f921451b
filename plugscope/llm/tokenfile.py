"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on the document id.

Rows lie in ascending id order over range-partitioned files, so stripe and row-group statistics of
``doc_id`` hardly overlap and a lookup reads few row groups; the Bloom filter rejects the rest. Ids
are a list of 32-bit integers in run-length encoding. Large files are read stripe by stripe in
parallel. Layout of a row: ``part`` (file number in id order), ``doc_id``, ``local_start`` (ids
before it in its file), ``n_tokens``, ``ids``.

Edge cases: a null text is empty and holds the end id only; null ids come first; rows with equal ids
are ordered by their text; an empty table gives no row. Extra columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import TOKENIZER, encoder

END_ID = 2
ROW_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
_FLUSH = 4_000_000  # ids that are handed on at once
_INDEX = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
    "orc.encoding.strategy": "SPEED",
}


def _rows(part: int, start: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    ends = np.cumsum(counts)
    values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
    columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), lists]
    return pa.record_batch(columns, names=["part", "doc_id", "local_start", "n_tokens", "ids"])


def _encoded(tokenizer: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        start = 0
        for batch in batches:
            docs, ids, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                ids.append(encode(text.as_py()) + end)
                size += len(ids[-1]) // 4
                if size >= _FLUSH:
                    yield _rows(part, start, docs, ids)
                    start, docs, ids, size = start + size, [], [], 0
            if docs:
                yield _rows(part, start, docs, ids)
                start += size

    return run


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write them to ORC files in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(_encoded(tokenizer, end_id), ROW_SCHEMA).write.options(**_INDEX).orc(path)


def read(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows of the files; a condition on doc_id reaches the stripe, row-group and Bloom-filter indexes."""
    rows = spark.read.schema(ROW_SCHEMA).orc(path)
    return rows if where is None else rows.where(where)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, first, total): ids before each file, from its counts alone; one row per file."""
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"), "total")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = np.asarray(lists.offsets)
        values = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
        crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document, from its ids."""
    rows = read(spark, path).select("part", "doc_id", "local_start", "ids")
    found = rows.mapInArrow(_digests, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    joined = found.join(file_starts(spark, path).select("part", "first"), "part")
    return joined.select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
