"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Shards own the arcs that end at their virtual nodes. Capacities are the row count split evenly, at
most one apart, so a shard that is full passes the keys of its arcs on clockwise to the next virtual
node of a shard with room. Counts of arcs (their number is fixed) go to the driver, where the walk
around the ring yields runs of ranks; each row then finds its run by the rank of its place in its arc.

Law: ``rows``. Edge cases: null texts count no bytes and the crc of the empty text; null ids hash
like any one key; repeated rows are rows of their own; an empty table gives no row. Rows of one key
that overflow may part. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

VIRTUAL = 64
#: Each arc is ranked in this many parts, so that neither a task nor a window holds a whole arc.
PARTS = 16
LAW = "rows"


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of virtual nodes, and their shards. A shard's nodes do not depend on the others."""
    owner = np.repeat(np.arange(shards), virtual)
    with np.errstate(over="ignore"):
        place = _mix((owner * 1_000_003 + np.tile(np.arange(virtual), shards) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(place, kind="stable")
    return place[order], owner[order]


def capacities(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards)


def runs(counts: np.ndarray, owners: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): each arc's keys in rank order, the overflow clockwise."""
    left, used, out = room.copy(), np.zeros(len(room), np.int64), []
    taken = np.zeros(len(counts), np.int64)

    def give(arc: int, shard: int) -> None:
        n = int(min(counts[arc] - taken[arc], left[shard]))
        if n > 0:
            out.append((arc, int(taken[arc]), int(taken[arc]) + n, int(shard), int(used[shard])))
            taken[arc] += n
            left[shard] -= n
            used[shard] += n

    for arc in range(len(counts)):
        give(arc, owners[arc])
    for arc in np.flatnonzero(taken < counts).tolist():
        step = 1
        while taken[arc] < counts[arc]:
            give(arc, owners[(arc + step) % len(owners)])
            step += 1
    return out


def shard(docs: DataFrame, shards: int, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    places, owners = ring(shards, virtual)

    @F.pandas_udf("int")
    def arc_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series((np.searchsorted(places, _mix(h.to_numpy(np.int64).view(np.uint64)), "left") % len(places)).astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("arc", arc_of("h"))
    # the row number decides between repeated rows, and deals them out
    stored = materialize(hashed.withColumn("row", F.monotonically_increasing_id()).withColumn("bin", F.pmod(F.xxhash64("doc_id", "row"), F.lit(PARTS)).cast("int")), "shard-rows")
    bins = stored.groupBy("arc", "bin").agg(F.count("*").alias("n")).toPandas().sort_values(["arc", "bin"])  # at most shards * virtual * PARTS rows
    counts = np.zeros(len(places), np.int64)
    np.add.at(counts, bins["arc"].to_numpy(np.int64), bins["n"].to_numpy(np.int64))
    bins["base"] = bins.groupby("arc")["n"].cumsum() - bins["n"]
    plan = runs(counts, owners, capacities(int(counts.sum()), shards))
    base = spark.createDataFrame(bins[["arc", "bin", "base"]].astype({"arc": "int32", "bin": "int32", "base": "int64"}), "arc int, bin int, base long")
    runs_df = spark.createDataFrame(plan, "arc int, lo long, hi long, shard int, first long")
    nth = F.row_number().over(Window.partitionBy("arc", "bin").orderBy("h", "doc_id", "row")) - 1
    ranked = stored.withColumn("nth", nth).join(F.broadcast(base), ["arc", "bin"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(runs_df), "arc").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))
