"""Incremental analysis: a stream of changed files keeps a corpus and its endpoints up to date.

Changes arrive as rows (drop, plugin_slug, file, content, deleted), for instance from a landing directory
(``landing``) whose drops are never rewritten: ``<root>/<drop>/<plugin>/<path>``, where ``<plugin>/<path>.deleted`` removes a file and
``<plugin>.deleted`` a plugin. Spark's file source passes over empty files, so a marker holds a byte, and a file that became
empty is dropped as removed. State keyed by plugin holds the digests of its files, so what a drop repeats
changes nothing. Each micro-batch rewrites the current files of the plugins that changed and analyses them again: the
plugin is the unit of work, since dedup, wrappers and graphs need all of its files.

Both tables are partitioned by plugin, and a changed plugin's partition is replaced. It always holds one
row that stands for the plugin alone (a null file or type), so a plugin that lost its last endpoint or file leaves
nothing else behind; ``endpoints`` and ``files`` read without it. A batch that runs twice leaves the same tables.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..plans.analyze import analyze
from ..plans.facts import shared_dir

CHANGES = "drop long, plugin_slug string, file string, content binary, deleted boolean"
FILES = "plugin_slug string, file string, content binary"
GONE = ".deleted"


def _replace(rows: DataFrame, slugs: DataFrame, path: str) -> None:
    """Replace the partitions of ``slugs`` by ``rows`` and a row for the plugin alone."""
    alone = slugs.select(*[F.col(c) if c == "plugin_slug" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    rows.unionByName(alone).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plugin_slug").parquet(path)


def endpoints(spark: SparkSession, path: str) -> DataFrame:
    """The endpoint table below ``path``."""
    return spark.read.parquet(path).where("type is not null").withColumn("plugin_slug", F.col("plugin_slug").cast("string"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """The current files below ``path``."""
    return spark.read.schema(FILES).parquet(path).where("file is not null")


def upsert(changed: DataFrame, current: Callable[[], DataFrame], path: str, config: Config | None = None) -> None:
    """Analyse plugins named in ``changed`` (plugin_slug) again and replace their endpoints below ``path``; a plugin may have none left."""
    slugs = changed.select("plugin_slug").distinct()
    held = current().join(slugs, "plugin_slug", "left_semi")
    _replace(analyze(held, config).endpoints, slugs, path)


def run(stream: DataFrame, current: Callable[[], DataFrame], path: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Start the incremental analysis over a stream with a plugin_slug column; all available input, then stop."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert(batch, current, path, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing(spark: SparkSession, root: str) -> DataFrame:
    """A stream of changes from a landing directory; drops are numbers, and later ones come after earlier ones."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").rpartition("://")[2].lstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), f"^/*{base}/", "")
    gone = F.col("rel").endswith(GONE)
    rows = rows.withColumn("rel", rel).withColumn("gone", gone).withColumn("rel", F.when(F.col("gone"), F.regexp_replace("rel", r"\.deleted$", "")).otherwise(F.col("rel")))
    parts, gone = F.split("rel", "/"), F.col("gone")
    named = F.array_join(F.slice(parts, 3, 1 << 20), "/")
    return rows.where((F.size(parts) >= 3) | gone & (F.size(parts) == 2)).select(parts[0].cast("long").alias("drop"), parts[1].alias("plugin_slug"), named.alias("file"), F.when(~gone, F.col("content")).alias("content"), gone.alias("deleted"))


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The files of a plugin that changed, and those that went; what its state does not know or knows otherwise."""
    known: dict[str, str] = json.loads(state.get[0]) if state.exists else {}
    latest: dict[str, tuple[int, bytes | None]] = {}
    cleared = -1  # the last drop that removed the whole plugin
    for pdf in batches:
        for drop, file, content, deleted in zip(pdf["drop"], pdf["file"], pdf["content"], pdf["deleted"]):
            if deleted and not file:
                cleared = max(cleared, drop)
            elif file not in latest or drop >= latest[file][0]:
                latest[file] = (drop, None if deleted else bytes(content if content is not None else b""))
    now = {} if cleared >= 0 else dict(known)
    bodies: dict[str, bytes] = {}
    for file, (drop, body) in latest.items():
        if drop < cleared:
            continue
        if body is None:
            now.pop(file, None)
        else:
            now[file], bodies[file] = hashlib.sha256(body).hexdigest(), body
    changed = [(key[0], f, bodies[f], False) for f, h in now.items() if known.get(f) != h]
    gone = [(key[0], f, None, True) for f in known if f not in now]
    if now:
        state.update((json.dumps(now),))
    elif state.exists:
        state.remove()
    if changed or gone:
        yield pd.DataFrame(changed + gone, columns=["plugin_slug", "file", "content", "deleted"])


def changes(stream: DataFrame) -> DataFrame:
    """(plugin_slug, file, content, deleted) of a stream of CHANGES: only what differs from the state of each plugin."""
    return stream.groupBy("plugin_slug").applyInPandasWithState(_track, f"{FILES}, deleted boolean", "known string", "append", GroupStateTimeout.NoTimeout)


def apply_changes(batch: DataFrame, path: str, config: Config | None = None) -> None:
    """Bring the tables below ``path`` (files, endpoints) up to date with a batch of changes."""
    spark = batch.sparkSession
    fresh = f"{shared_dir(spark)}/plugscope/changes-{uuid.uuid4().hex}"
    batch.write.parquet(f"{fresh}/changes")  # the stream's rows are read several times below
    batch = spark.read.schema(batch.schema).parquet(f"{fresh}/changes")
    slugs = batch.select("plugin_slug").distinct()
    if slugs.isEmpty():
        return
    try:
        held = files(spark, f"{path}/files").join(slugs, "plugin_slug", "left_semi").join(batch, ["plugin_slug", "file"], "left_anti")
        now = held.unionByName(batch.where("not deleted").select("plugin_slug", "file", "content"))
        now.write.parquet(f"{fresh}/files")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        batch.where("not deleted").select("plugin_slug", "file", "content").write.parquet(f"{fresh}/files")
    now = spark.read.schema(FILES).parquet(f"{fresh}/files")
    # endpoints first: should the batch stop in between, it runs again from the files of before
    _replace(analyze(now, config).endpoints, slugs, f"{path}/endpoints")
    _replace(now, slugs, f"{path}/files")


def maintain(stream: DataFrame, path: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Keep the tables below ``path`` up to date with a stream of CHANGES; all available input, then stop."""
    return changes(stream).writeStream.outputMode("append").foreachBatch(lambda batch, _: apply_changes(batch, path, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
