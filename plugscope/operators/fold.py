"""The dedup fold as an associative operation, so that a group of any size is split over tasks.

A survivor is judged by its level and by whether its callback says something: 14 states. What a run of rows
does to a survivor is therefore a table from states to the row that replaces it, and tables of neighbouring
runs compose. Rows are range-partitioned by group and order; a task folds its groups row by row in constant memory,
and for its first group, which may have begun in an earlier task, makes the run's table, too. Groups that
cross tasks are then put together from one survivor and a few table rows of each task they lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W

STATES = [(level, says_nothing) for level in range(len(W.LEVELS)) for says_nothing in (False, True)]


def replaces(old: tuple[int, bool], new: tuple[int, bool]) -> bool:
    """Whether a later row takes the survivor's place: a higher level, unless the survivor is public, or the first callback that says something."""
    return new[0] > old[0] != 0 or old[1] and not new[1]


class _Group:
    """A group's rows in a task: its survivor, and what its rows do to each state."""

    def __init__(self, with_table: bool):
        self.best: tuple | None = None  # state, batch, place
        self.table: dict[tuple[int, bool], tuple] | None = {} if with_table else None

    def add(self, state: tuple[int, bool], batch: pa.RecordBatch, at: int) -> None:
        if self.best is None or replaces(self.best[0], state):
            self.best = (state, batch, at)
        if self.table is not None:
            for s in STATES:
                if replaces(self.table[s][0] if s in self.table else s, state):
                    self.table[s] = (state, batch, at)


def _folded(key: list[str], names: list[str]):
    schema = [*names, "__task", "__state", "__spans"]

    def rows(group: _Group, spans: bool) -> list[tuple]:
        out = [(group.best, -1, spans)]
        return out + [(r, STATES.index(s), spans) for s, r in (group.table or {}).items()]

    def batches_of(found: list[tuple], task: int) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for f in found:
            by.setdefault(id(f[0][1]), []).append(f)
        for own in by.values():
            taken = own[0][0][1].take(pa.array([f[0][2] for f in own], pa.int64()))
            extra = [pa.array([task] * len(own), pa.int32()), pa.array([f[1] for f in own], pa.int32()), pa.array([f[2] for f in own], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *extra], names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, group = TaskContext.get().partitionId(), None, None
        first = True
        for batch in batches:
            done: list[tuple] = []
            levels, callbacks = batch.column("auth_level").to_pylist(), batch.column("callback").to_pylist()
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in key))):
                if group is None or k != now:
                    if group is not None:
                        done += rows(group, first)
                        first = False
                    now, group = k, _Group(first)
                group.add((levels[i], callbacks[i] in W.GENERIC_CALLBACKS), batch, i)
            yield from batches_of(done, task)
        if group is not None:
            yield from batches_of(rows(group, True), task)

    return run


def dedup(endpoints: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per (plugin, route, method, type), the fold over its rows in order of file and callback, then of all other columns."""
    key = ["plugin_slug", "route", "method", "type"]
    names = endpoints.columns
    rest = [c for c in names if c not in key]
    order = ["file", "callback", *[c for c in ("line", "auth_level", "raw_code") if c in rest]]
    order += [c for c in rest if c not in order]
    dealt = endpoints.repartitionByRange(parts, *key, *order) if parts else endpoints.repartitionByRange(*key, *order)
    schema = T.StructType([*endpoints.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__state", T.IntegerType()), T.StructField("__spans", T.BooleanType())])
    from . import graph

    found = graph._write(dealt.sortWithinPartitions(*key, *order).mapInArrow(_folded(key, names), schema), "folded")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__task", "__state"], kind="stable").reset_index(drop=True)
        states = [(int(v), c in W.GENERIC_CALLBACKS) for v, c in zip(pdf["auth_level"], pdf["callback"])]
        best = None
        for _, run in pdf.groupby("__task", sort=True):
            if best is None:
                best = run.index[0]  # the survivor of the first task's rows
                continue
            to = {int(s): i for s, i in zip(run["__state"], run.index)}
            best = to.get(STATES.index(states[best]), best)
        return pdf.loc[[best], names]

    crossing = found.where("__spans").groupBy(*key).applyInPandas(compose, endpoints.schema)  # at most 15 rows of a group from each task
    return found.where("not __spans").select(*names).unionByName(crossing)
