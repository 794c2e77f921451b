"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; the filter
stages keep the columns of ``documents``. SQL cannot express the stages, so ORACLE_SQL is None and
tests hold the run against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plugscope.llm import decontaminate, langid, packing, simhash
from plugscope.llm.common import materialize, table

#: Below this mean confidence over its whole text a document has no one language.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is null, has no letter, or is of no one language."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = docs.withColumn("__lang", langid.predict_column(model, F.col("text")))
    return found.where((F.col("__lang.lang") != langid.UNKNOWN) & (F.col("__lang.score") >= LEAST_SCORE)).drop("__lang")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least (doc_id, fingerprint) of each component; of repeated rows, one."""
    # written once with a row number, so that both passes below see the same numbers
    tagged = materialize(docs.withColumn("__fp", simhash.fingerprint_column(F.col("text"))).withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")
    marks = tagged.select("__row", F.col("doc_id").alias("id"), F.col("__fp").alias("fp"))
    least = materialize(marks.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("least")), "dedup-least")
    nodes = simhash.components(simhash.links(least))
    rooted = least.join(nodes, least["fp"] == nodes["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.__row").alias("__row"))
    # both sides grow with the corpus: never broadcast
    return tagged.join(kept.hint("merge"), "__row", "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, exactly or within the edit bound."""
    return decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), out="__hits").where(F.size("__hits") == 0).drop("__hits")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
