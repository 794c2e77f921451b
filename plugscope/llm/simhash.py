"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a radius.

Fingerprints within the radius agree in at least ``BLOCKS - RADIUS`` of ``BLOCKS`` bit blocks, so
every link falls into a bucket of some combination of that many blocks. In a bucket the fingerprints
lie as vertical bit planes: one machine word holds the same bit of 64 fingerprints. Distances to a
fingerprint grow in carry-save counters, and a block of words is left as soon as all of its
fingerprints are beyond the radius. A bucket gives links that connect the same fingerprints as all
of its links would; a distributed component search follows.

Edge cases: a null or wordless text has fingerprint 0 and is linked like any other. Fewer words than
a shingle give one shingle. Very long texts are hashed in runs of 65,536 shingles. An empty table has no
component. Repeated rows and equal texts share a fingerprint. Null ids count as the
largest. Extra columns are ignored by ``components`` and kept by ``with_fingerprints``,
which replaces one of the result's own name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, trim

RADIUS = 4
SHINGLE = 4
BLOCKS = 6
#: A bucket above this size is dealt out again by the blocks that its key leaves open.
LARGE = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
_SPANS = list(zip(_EDGES, _EDGES[1:]))
_KEYS = list(combinations(range(BLOCKS), BLOCKS - RADIUS))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(joined), 65536):
        h = np.array([digest(s.encode("utf-8", "replace"), seed) for s in joined[i : i + 65536]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(joined), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
        trim()

    return of(text)


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    return docs.withColumn(out, fingerprint_column(F.col(text_col)))


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Planes:
    """Bit planes of fingerprints: ``planes[b, w]`` has bit b of fingerprints 64w to 64w+63."""

    BLOCK = 64  # words whose counters are updated, and abandoned, together

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        words = -(-self.n // 64)
        full = np.zeros(words * 64, np.uint64)
        full[: self.n] = fps
        bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")

    def within(self, fp: int, open_words: np.ndarray, radius: int) -> np.ndarray:
        """Words with a set bit for each open fingerprint at distance ``radius`` or less."""
        out = np.zeros(len(open_words), np.uint64)
        todo = np.flatnonzero(open_words)
        for i in range(0, len(todo), self.BLOCK):
            at = todo[i : i + self.BLOCK]
            over = ~open_words[at]  # already beyond, or not asked for
            counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
            for b in range(64):
                plane = self.planes[b, at]
                carry = ~plane if fp >> b & 1 else plane
                for k, c in enumerate(counters):
                    counters[k], carry = c ^ carry, c & carry
                over |= carry  # the counter overflowed
                if b >= radius and b % 4 == 3:
                    if not (~(over | _above(counters, radius))).any():
                        break
            out[at] = ~(over | _above(counters, radius))
        return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the counter is greater than ``radius``."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def _unpack(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def bucket_links(fps: np.ndarray, radius: int = RADIUS, bits: tuple = ()) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all links among distinct fingerprints.

    ``bits``: those in which the fingerprints may differ. A large bucket is dealt out by each of
    radius + 1 parts of those bits, in one of which any link agrees; what is still large, but a quarter
    of it at most, is dealt out again by the bits that are left.
    """
    n = len(fps)
    if n < 2:
        return []
    if n == 2:
        return [(int(fps[0]), int(fps[1]))] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    if n > LARGE and len(bits) > radius:
        links = []
        for part in range(radius + 1):
            mask = np.uint64(sum(1 << b for b in bits[part :: radius + 1]))
            key = fps & mask
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            left = tuple(b for b in bits if b not in bits[part :: radius + 1])
            for group in np.split(fps[order], cuts):
                links += bucket_links(group, radius, left if 4 * len(group) <= n else ())
        return links
    planes = Planes(fps)
    left = np.zeros(planes.planes.shape[1], np.uint64)
    left[: n // 64] = ~np.uint64(0)
    if n % 64:
        left[n // 64] = np.uint64((1 << n % 64) - 1)
    links = []
    for first in range(n):
        if not left[first // 64] >> np.uint64(first % 64) & np.uint64(1):
            continue
        left[first // 64] &= ~(np.uint64(1) << np.uint64(first % 64))
        queue = [first]
        while queue:
            at = queue.pop()
            near = planes.within(int(fps[at]), left, radius)
            left &= ~near
            for other in _unpack(near).tolist():
                links.append((int(fps[at]), int(fps[other])))
                queue.append(other)
    return links


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, blocks in enumerate(_KEYS):
            mask = np.uint64(sum(((1 << hi - lo) - 1) << lo for lo, hi in (_SPANS[b] for b in blocks)))
            yield pa.record_batch([pa.array(np.full(len(fps), k, np.int32)), pa.array((fps & mask).view(np.int64)), batch.column(0)], names=["k", "key", "fp"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k, key); the last bucket of a batch waits for the next batch."""

    def flush(k: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (key[1:] != key[:-1])]) if len(k) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(k))
        links: list[tuple[int, int]] = []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            free = tuple(bit for b in range(BLOCKS) if b not in _KEYS[k[s]] for bit in range(*_SPANS[b]))
            links += bucket_links(fp[s:e].view(np.uint64), RADIUS, free)
        if links:
            a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*links))
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held = None
    for batch in batches:
        k, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(k):
            continue
        if held is not None and (k[0], key[0]) == (held[0][0][0], held[1][0][0]):
            last = np.flatnonzero((k != k[0]) | (key != key[0]))
            cut = last[0] if len(last) else len(k)
            for store, column in zip(held, (k, key, fp)):
                store.append(column[:cut])
            if cut == len(k):
                continue
            k, key, fp = k[cut:], key[cut:], fp[cut:]
        if held is not None:
            yield from flush(*map(np.concatenate, held))
        cut = np.flatnonzero((k != k[-1]) | (key != key[-1]))
        cut = cut[-1] + 1 if len(cut) else 0
        yield from flush(k[:cut], key[:cut], fp[:cut])
        held = ([k[cut:]], [key[cut:]], [fp[cut:]])
    if held is not None:
        yield from flush(*map(np.concatenate, held))



def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect what all links within the radius connect; ``distinct``: column fp, no repeats."""
    keyed = distinct.select("fp").mapInArrow(_keyed, "k int, key long, fp long")
    dealt = keyed.repartition(F.col("k"), F.col("key")).sortWithinPartitions("k", "key", "fp")
    return dealt.mapInArrow(_linked, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root): root is the least node of the component; only nodes with a link appear.

    Alternating large-star and small-star steps, each written to the shared folder, until no edge changes.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        step = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(step, label)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id of the component of the row's text."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = components(links(least))
    rooted = least.join(nodes, least["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
