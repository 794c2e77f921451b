"""URL filters with DataFrame functions only.

Each URL is expanded into host suffixes and path prefixes; an expression's SHA-256 digest is joined
with the rules on its first ``PREFIX`` hex digits, the full digest confirms it, and the longest rule
wins (the longer host where two are equally long). Suffixes and prefixes are made for the label
counts and path lengths that occur among the rules, so nothing that could fit is left out.

Rules are broadcast up to ``SMALL`` of them (counted); beyond that both sides are shuffled on the
digest prefix, with the pages' side salted, since a suffix such as ``com`` may hold most rows.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule. A rule whose
host or path is null is ignored; of repeated rules, block comes before allow. Pages keep their rows,
repeated ones too; null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
SMALL = 20_000
SALTS = 16
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``rules``: host, path, verdict."""
    rules = rules.where("host is not null and path is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.count("*"), F.collect_set(F.size(F.split("host", "\\."))), F.collect_set(F.length("path"))).first()  # one label count or length each, few
    count, labels, lengths = shape[0], sorted(shape[1]), sorted(shape[2])
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not count:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    n_labels = F.size(F.split("host", "\\."))
    hosts = F.filter(F.transform(F.array(*map(F.lit, labels)), lambda k: F.when(k <= n_labels, F.array_join(F.slice(F.split("host", "\\."), F.greatest(n_labels - k + 1, F.lit(1)), k), "."))), lambda x: x.isNotNull())
    paths = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda k: F.when(k <= F.length("path"), F.substring("path", F.lit(1), k))), lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    wide = rows.withColumn("pair", F.explode_outer(pairs)).withColumn("full", _digest(F.col("pair.h"), F.col("pair.p")))
    wide = wide.select("row", "page_id", "host", "path", "full", F.substring("full", 1, PREFIX).alias("short"))
    known = rules.select(_digest(F.col("host"), F.col("path")).alias("rule_full"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict").withColumn("short", F.substring("rule_full", 1, PREFIX))
    if count <= SMALL:
        met = wide.join(F.broadcast(known), "short", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = wide.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    fit = F.when(F.col("full") == F.col("rule_full"), F.struct(F.length("rule"), "host_length", "rule", "verdict"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(fit).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
