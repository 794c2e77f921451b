"""The fact base: each PHP file is parsed once; everything after is relational."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Config

_FN = "array<struct<name:string,class:string,class_fqn:string,is_closure:boolean,is_static:boolean,visibility:string,params:array<string>,off:int,end_off:int,line:int,level:int,guard:int,returns:int,returns_of:array<string>,reads_input:boolean,has_nonce:boolean,fields:array<string>,keys:array<string>,capability:string,literals:array<string>,calls:array<string>,ordered:array<string>,asks:array<string>,first_field:string,query_var:string>>"
_CLASS = "array<struct<name:string,fqn:string,kind:string,parent:string,interfaces:array<string>,traits:array<string>,rules:array<struct<trait:string,method:string,alias:string,instead:array<string>>>,off:int,end_off:int,line:int>>"
_ITEM = "array<struct<arg:int,grp:int,key:string,value:string,val:string,cb:string>>"
_CALL = f"array<struct<off:int,line:int,callee:string,receiver_kind:string,receiver:string,args:array<string>,vals:array<string>,callbacks:array<string>,items:{_ITEM},raw:string,enclosing_class:string,enclosing_fn:string,class_fqn:string,type:string,holders:array<string>,loops:array<int>,context_level:int,raw_level:int,before:string>>"
FACTS = f"struct<functions:{_FN},classes:{_CLASS},calls:{_CALL},symbols:array<struct<class:string,kind:string,name:string,value:string,off:int>>,foreachs:array<struct<off:int,end_off:int,kind:string,source:string,literals:array<string>,loop_var:string,loop_key:string>>,includes:array<struct<off:int,kind:string,target:string,raw:string,node:string,given:array<int>,hints:array<string>>>,namespace:string,uses:map<string,string>,direct:boolean>"

FILES = 64  # files whose facts are sent together
BROADCAST_ROWS = 20_000  # of a written table up to which joins may broadcast it


TABLES = ["calls", "functions", "classes", "symbols", "foreachs", "includes"]
ORDER = {"calls": "callee", "functions": "name", "symbols": "name"}  # what most filters ask for, so that row groups are left out


class Facts:
    """Tables of the fact base, all keyed by (plugin_slug, file); each is flattened and written when first asked for."""

    def __init__(self, base: DataFrame):
        self.base = base
        self._flat: dict[str, DataFrame] = {}
        self._locks = {name: Lock() for name in TABLES}

    def _rows(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._flat:
                rows = self.base.select("plugin_slug", "file", F.explode(f"f.{name}").alias("r")).select("plugin_slug", "file", "r.*")
                rows = rows.sortWithinPartitions(ORDER[name]) if name in ORDER else rows
                self._flat[name] = written(rows, f"{shared_dir(rows.sparkSession)}/plugscope/{name}-{uuid.uuid4().hex}")
            return self._flat[name]

    def prepare(self) -> Facts:
        """Flatten all tables at once."""
        together(self.base.sparkSession, *[lambda name=name: self._rows(name) for name in TABLES])
        return self

    @property
    def files(self) -> DataFrame:
        return self.base.select("plugin_slug", "file", F.col("f.namespace").alias("namespace"), F.col("f.uses").alias("use_map"), F.col("f.direct").alias("direct"), "error")

    @property
    def calls(self) -> DataFrame:
        return self._rows("calls")

    @property
    def functions(self) -> DataFrame:
        return self._rows("functions")

    @property
    def classes(self) -> DataFrame:
        return self._rows("classes")

    @property
    def symbols(self) -> DataFrame:
        return self._rows("symbols")

    @property
    def foreachs(self) -> DataFrame:
        return self._rows("foreachs")

    @property
    def includes(self) -> DataFrame:
        return self._rows("includes")


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Results of independent jobs, planned and submitted from threads of their own."""
    with ThreadPoolExecutor(len(jobs) or 1) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def parse(files: DataFrame, config: Config | None = None) -> DataFrame:
    """(plugin_slug, file, f, error) of PHP files; a file that cannot be parsed is a row with an error."""
    config = config or Config()
    schema = StructType.fromDDL(f"plugin_slug string, file string, f {FACTS}, error string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..php.facts import facts

        def row(slug: str, file: str, data: bytes) -> dict:
            found, error = None, None
            if b"\0" in data[:512]:
                error = "binary"
            else:
                try:
                    found = facts(data.decode("utf-8", "replace"), config)
                except (ValueError, IndexError, KeyError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
            return {"plugin_slug": slug, "file": file, "f": found, "error": error}

        for batch in batches:
            slugs, names, contents = batch.columns
            for k in range(0, len(slugs), FILES):
                rows = [row(slugs[j].as_py(), names[j].as_py(), contents[j].as_py() or b"") for j in range(k, min(k + FILES, len(slugs)))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("plugin_slug", "file", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def build(files: DataFrame, config: Config | None = None, path: str | None = None) -> Facts:
    """Parse files and keep the facts as Parquet, by default in the folder the cluster shares.

    Files are dealt out first: parsing takes far longer than reading, so what one read task holds is work for many.
    """
    spark = files.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = parse(files.repartition(tasks, "plugin_slug", "file"), config)
    path = path or f"{shared_dir(spark)}/plugscope/facts-{uuid.uuid4().hex}"
    return Facts(written(base, path))


def written(df: DataFrame, path: str) -> DataFrame:
    """A table written as Parquet and read back.

    Encoded files are far smaller than their rows in memory, and a few columns are taken for a part of that: by their
    size Spark would send tables of millions of rows through the driver. From ``BROADCAST_ROWS`` on, joins merge.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.hint("merge") if seen.get["rows"] > BROADCAST_ROWS else back


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a local master, as in tests, may do without it."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    master = conf.get("spark.master", "local")
    if not found and (not master.startswith("local") or "cluster" in master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")
