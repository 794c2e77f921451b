"""Packing into sequences by cutting-stock column generation.

A document of n ids fills ``n // LENGTH`` sequences whole; its remainder is an order of one of
LENGTH - 1 lengths. The histogram of remainders, whose size does not grow with the corpus, goes to
the driver. A linear program over patterns (multisets of lengths that fit a sequence) covers it: a
revised simplex whose new columns come from a knapsack dynamic program over the dual prices. The
solution is rounded down; patterns that leave more than ``WASTE`` ids are dropped. What that leaves
gets integer columns at the solution's dual prices, one at a time: a knapsack over what is left finds the
column of most value that fills a sequence but for ``WASTE`` ids, and at the end for one in ``LAST_SHARE``.
Remainders are ranked within their length, and a rank tells pattern copy, place and offset in closed form.
Ranks beyond all patterns, of lengths that nothing left fills up, are laid end to end and cut at sequence borders.

Edge cases: a null or empty text is the end id alone; a very long text fills whole sequences; equal
lengths (ties) take their places in the order of task and row; repeated rows are packed each; null ids
are kept; an empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trim
from .tokens import TOKENIZER, encoder

LENGTH = 1024
END_ID = 0
WASTE = 4
LAST_SHARE = 16  # the last patterns, made of the few orders that all others leave, waste up to this part of a sequence
ENOUGH = 0.999  # of a sequence's price; an optimal column is worth 1
GAP = 2e-3
PIVOTS = 400
MOST_BYTES = 32_000_000  # of the tasks' first ranks, to be sent to every executor
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_FLUSH = 16_000_000


def knapsack(prices: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of lengths 1..length-1 that fits ``length``; ``prices[l]`` for length l."""
    best, took = np.zeros(length + 1), np.zeros(length + 1, np.int64)
    for room in range(1, length + 1):
        top = min(room, len(prices) - 1)
        gain = prices[1 : top + 1] + best[room - 1 :: -1][:top]
        at = int(gain.argmax())
        best[room], took[room] = (gain[at], at + 1) if gain[at] > best[room - 1] else (best[room - 1], 0)
    pattern, room = np.zeros(len(prices), np.int64), length
    while room:
        if took[room]:
            pattern[took[room]] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[length]), pattern


def column_generation(demand: np.ndarray, length: int = LENGTH, gap: float = GAP, pivots: int = PIVOTS) -> tuple[list[tuple[float, np.ndarray]], np.ndarray]:
    """(copies, pattern) of a solution of the linear program, and its dual prices; ``demand[l]``: orders of length l."""
    sizes = np.flatnonzero(demand)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return [], np.zeros(len(demand))
    patterns = []
    for size in sizes:  # a start that fills sequences: a length with its complement, then what is left alone
        p = np.zeros(len(demand), np.int64)
        other = length - size
        if demand[other] > 0 and (demand[size], size) < (demand[other], other):
            p[size] = p[other] = 1
        else:
            p[size] = length // size
        patterns.append(p)
    inverse = np.linalg.inv(np.array([p[sizes] for p in patterns], float).T)
    amount, total, change = np.maximum(inverse @ demand[sizes], 0), inverse.sum(axis=0), np.empty_like(inverse)
    for step in range(pivots):
        if step % 200 == 199:  # keeps rounding errors small
            inverse = np.linalg.inv(np.array([p[sizes] for p in patterns], float).T)
            amount, total = np.maximum(inverse @ demand[sizes], 0), inverse.sum(axis=0)
        prices = np.zeros(len(demand))
        prices[sizes] = total
        value, pattern = knapsack(np.maximum(prices, 0), length)
        if value <= 1 + gap:  # the optimum is at least (sum of amounts) / value
            break
        own = pattern[sizes]
        at = np.flatnonzero(own)
        column = inverse[:, at] @ own[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, amount / column, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step_size = ratio[out]
        amount = amount - step_size * column
        amount[out] = step_size
        amount = np.maximum(amount, 0)
        row = inverse[out] / column[out]
        total = total + (1 - column.sum()) * row
        np.multiply(column[:, None], row, out=change)
        inverse -= change
        inverse[out] = row
        patterns[out] = pattern
    prices = np.zeros(len(demand))
    prices[sizes] = np.maximum(total, 0)
    return [(float(x), p) for x, p in zip(amount, patterns) if x > 1e-9], prices


def bounded_knapsack(prices: np.ndarray, left: np.ndarray, length: int, waste: int, enough: float) -> np.ndarray | None:
    """The most valuable multiset of lengths, at most ``left`` of each, that fills ``length`` but for ``waste``; the first found that fills it and is worth ``enough``."""
    best, steps = np.full(length + 1, -np.inf), []  # of multisets that add up to exactly so much
    best[0] = 0
    for size in np.flatnonzero(left[: length + 1])[::-1].tolist():
        copies, times = min(int(left[size]), length // size), 1
        while copies > 0:  # 1, 2, 4, ... copies at once
            k = min(times, copies)
            copies, times = copies - k, times * 2
            if k * size > length:
                break
            gain = best[: length + 1 - k * size] + k * prices[size]
            more = gain > best[k * size :] + 1e-12
            if more.any():
                steps.append((size, k, more))
                best[k * size :][more] = gain[more]
        if best[length] >= enough:
            break
    room = length - waste + int(best[length - waste :].argmax())
    if best[room] == -np.inf:
        return None
    pattern = np.zeros(len(left), np.int64)
    for size, k, more in reversed(steps):
        if room >= k * size and more[room - k * size]:
            pattern[size] += k
            room -= k * size
    return pattern


def priced(left: np.ndarray, prices: np.ndarray, length: int, waste: int) -> list[tuple[int, np.ndarray]]:
    """(copies, pattern) of columns that the prices find among the orders ``left``, which are taken off, as long as any fills a sequence."""
    out = []
    prices = prices + 1e-3 * np.arange(len(left)) / length  # among equals, what fills more
    while (pattern := bounded_knapsack(prices, left, length, waste, ENOUGH)) is not None:
        held = np.flatnonzero(pattern)
        copies = int((left[held] // pattern[held]).min())
        left -= copies * pattern
        out.append((copies, pattern))
    return out


@dataclass
class Plan:
    """Where the r-th remainder of each length goes; at most a few entries per pattern."""

    length: int
    copies: int  # sequences of patterns
    tail: int  # sequences of remainders that are cut
    cuts: list[np.ndarray]  # per length: first rank of each run of pattern places
    runs: list[list[tuple[int, int, int]]]  # per length: (first sequence, places a copy, first offset)
    covered: list[int]
    loose: list[int]  # per length: first id place of the ranks beyond the patterns

    def place(self, size: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(first id, length, sequence, offset) of the pieces of the remainder of ``size`` ids with ``rank``."""
        if rank < self.covered[size]:
            k = int(np.searchsorted(self.cuts[size], rank, "right")) - 1
            sequence, places, offset = self.runs[size][k]
            copy, place = divmod(rank - int(self.cuts[size][k]), places)
            return [(0, size, sequence + copy, offset + place * size)]
        at, out, done = self.loose[size] + (rank - self.covered[size]) * size, [], 0
        while done < size:
            sequence, offset = divmod(at + done, self.length)
            step = min(size - done, self.length - offset)
            out.append((done, step, self.copies + sequence, offset))
            done += step
        return out


def plan(demand: np.ndarray, length: int = LENGTH, waste: int = WASTE) -> Plan:
    """``demand[l]`` remainders of length l, 0 <= l < length."""
    demand = demand.astype(np.int64).copy()
    demand[0] = 0
    sizes = np.arange(len(demand))
    cuts: list[list[int]] = [[] for _ in demand]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in demand]
    left, chosen = demand.copy(), []
    found, prices = column_generation(demand, length)
    for amount, pattern in found:
        held = np.flatnonzero(pattern)
        copies = min(int(amount + 1e-6), int((left[held] // pattern[held]).min()))
        if copies >= 1 and length - int(pattern @ sizes) <= waste:
            chosen.append((copies, pattern))
            left -= copies * pattern
    # what rounding leaves gets integer columns at the same prices, the last ones with more waste
    for most in (waste, max(waste, length // LAST_SHARE)):
        chosen += priced(left, prices, length, most)
    covered, sequence = [0] * len(demand), 0
    for copies, pattern in chosen:
        offset = 0
        for s in np.flatnonzero(pattern).tolist():
            cuts[s].append(covered[s])
            runs[s].append((sequence, int(pattern[s]), offset))
            covered[s] += copies * int(pattern[s])
            offset += s * int(pattern[s])
        sequence += copies
    left = (demand - np.array(covered)) * sizes
    loose = np.cumsum(left) - left
    return Plan(length, sequence, -(-int(left.sum()) // length), [np.array(c, np.int64) for c in cuts], runs, covered, loose.tolist())


def _narrow(ids: bytes) -> bytes:
    """Ids below 2**16 take two bytes each: a leading 2 says so, a 4 that they take four."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 65536 else b"\x04" + ids


def _wide(stored: bytes) -> bytes:
    return np.frombuffer(stored, "<u2", offset=1).astype("<u4").tobytes() if stored[0] == 2 else stored[1:]


TOKEN_SCHEMA = "part int, rem int, rank long, before long, whole long, doc_id long, n_tokens long, ids binary"


def _ranked(tokenizer: str, end_id: int, length: int):
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("part", pa.int32()), ("rem", pa.int32()), ("rank", pa.int64()), ("before", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        ranks, before, rows, size = [0] * length, 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                whole, rem = divmod(n, length)
                rows.append((part, rem, ranks[rem], before, whole, doc, n, _narrow(ids)))
                ranks[rem] += 1
                before += whole
                size += len(ids)
                if size > _FLUSH:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        trim()

    return run


def _placed(plan: Plan):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    length, first_whole = plan.length, plan.copies + plan.tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            rems, ranks, befores, wholes, docs, counts, base, whole_base = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 7, 8))
            for i, stored in enumerate(batch.column(6)):
                ids = _wide(stored.as_py())
                doc, n, whole, rem = docs[i], counts[i], wholes[i], rems[i]
                for k in range(whole):
                    rows.append((doc, k * length, length, n, first_whole + whole_base[i] + befores[i] + k, 0, ids[4 * k * length : 4 * (k + 1) * length]))
                if rem:
                    lead = whole * length
                    for s, step, sequence, offset in plan.place(rem, base[i] + ranks[i]):
                        rows.append((doc, lead + s, step, n, sequence, offset, ids[4 * (lead + s) : 4 * (lead + s + step)]))
                size += len(ids)
                if size > _FLUSH:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        trim()

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers (PIECE_SCHEMA).

    Encoded documents are written once to the shared folder. Ranks are local to the task that wrote
    a row; each (task, length) adds the count of that length in earlier tasks, which comes by a join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = materialize(rows.mapInArrow(_ranked(tokenizer, end_id, length), TOKEN_SCHEMA), "packing-tokens")
    counts = stored.groupBy("part", "rem").agg(F.count("*").alias("n"), F.sum("whole").alias("whole"))
    counts = materialize(counts, "packing-counts")
    demand = np.zeros(length, np.int64)
    for r in counts.groupBy("rem").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        demand[r["rem"]] = r["n"]
    earlier = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", F.struct("rem", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).alias("one"), "whole")
    first = first.groupBy("part").agg(F.array_sort(F.collect_list("one")).alias("all"), F.sum("whole").alias("whole"))  # at most ``length`` entries a task
    first = first.select("part", F.col("all.rem").alias("rems"), F.col("all.base").alias("bases"), F.coalesce(F.sum("whole").over(tasks), F.lit(0)).alias("whole_base"))
    first = materialize(first, "packing-bases")
    size = first.agg(F.sum(F.size("rems"))).first()[0] or 0
    # a row of each task; when they are many, rows with ids are shuffled instead
    joined = stored.join(F.broadcast(first) if 12 * size <= MOST_BYTES else first.hint("merge"), "part")
    base = F.get("bases", (F.array_position("rems", F.col("rem")) - 1).cast("int")).alias("base")
    return joined.select("rem", "rank", "before", "whole", "doc_id", "n_tokens", "ids", base, "whole_base").mapInArrow(_placed(plan(demand, length)), PIECE_SCHEMA)


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequences, tokens, padding): a sequence is padded to ``length`` unless it ends at a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(F.lit(length) - F.col("n"))
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
