"""Whole analyses: corpus to report, single plugins, reachability, and the accessors over results."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import Config
from ..functions import rules as R
from ..functions import words as W
from ..operators import detect, fold, graph, report
from ..sources import corpus, remote
from .facts import Facts, build, shared_dir, written


@dataclass
class Analysis:
    """Tables of a finished analysis; endpoints are written once and read back by every accessor."""

    endpoints: DataFrame
    plugins: DataFrame
    facts: Facts

    def summary(self) -> DataFrame:
        return report.summary(self.endpoints, self.plugins)

    def by_level(self, name: str) -> DataFrame:
        return report.filter_levels(self.endpoints, [name])

    def by_plugin(self, slug: str) -> DataFrame:
        return self.endpoints.where(F.col("plugin_slug") == slug)

    def by_type(self, kind: str) -> DataFrame:
        if kind not in W.TYPES:
            raise ValueError(f"unknown endpoint type: {kind}")
        return self.endpoints.where(F.col("type") == kind)

    def authenticated(self) -> DataFrame:
        return report.filter_levels(self.endpoints, authenticated=True)

    def coverage(self) -> DataFrame:
        return report.coverage(self.endpoints, self.facts.calls)

    def coverage_gaps(self) -> DataFrame:
        return report.coverage_gaps(self.endpoints, self.facts.calls)

    @cached_property
    def reach(self) -> graph.Reach:
        """Calls resolved by receiver and include edges, written once for all that follows them."""
        return graph.Reach(self.facts)

    def with_chains(self, compat: bool = False) -> DataFrame:
        """Endpoints with all that their callbacks call: by receiver, or with ``compat`` by bare names."""
        return report.attach_chains(self.endpoints, self.facts.functions, None if compat else self.reach)

    def trees(self, compat: bool = False) -> DataFrame:
        return report.call_trees(self.endpoints, self.facts.functions, None if compat else self.reach)

    def reachable_files(self) -> DataFrame:
        return graph.reachable_files(self.facts, self.endpoints, self.reach)

    def callback_files(self) -> DataFrame:
        """The files that each endpoint's callback can reach."""
        return graph.callback_files(self.facts, self.endpoints, self.reach)


def analyze(files: DataFrame, config: Config | None = None, compat: bool = False) -> Analysis:
    """Analyse corpus files (plugin_slug, file, content): parse, detect, resolve, dedup."""
    config = config or Config()
    kept = corpus.php_files(files, config)
    facts = build(kept, config).prepare()
    found = report.dedup(report.resolve_routes(detect.detect_all(facts, config, compat), facts)).drop("off")
    path = f"{shared_dir(files.sparkSession)}/plugscope/endpoints-{uuid.uuid4().hex}"
    endpoints = written(found, path)
    counts = facts.files.groupBy("plugin_slug").agg(F.count("*").alias("files_analyzed"), F.array_sort(F.collect_set(F.concat_ws(": ", "file", "error"))).alias("noted"), F.count("error").alias("n_errors"))
    counts = counts.select("plugin_slug", "files_analyzed", F.when(F.col("n_errors") > 0, F.filter("noted", lambda x: F.contains(x, F.lit(": ")))).otherwise(F.array().cast("array<string>")).alias("errors"))
    plugins = counts.join(corpus.plugin_headers(files), "plugin_slug", "left").select("plugin_slug", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("version", F.lit("")).alias("version"), "files_analyzed", "errors")
    return Analysis(endpoints, plugins, facts)


def analyze_directory(spark: SparkSession, root: str, config: Config | None = None, compat: bool = False) -> Analysis:
    """A directory is one plugin if a PHP file at its root has a plugin header, else each sub-directory is one."""
    whole = corpus.read_corpus(spark, root, single=True)
    single = corpus.is_single_plugin(whole).first()["single"]
    return analyze(whole if single else corpus.read_corpus(spark, root), config, compat)


def verify_reachability(files: DataFrame, targets: DataFrame, config: Config | None = None) -> DataFrame:
    """Targets (plugin_slug, relative_path) with direct and reachable matches; vendor directories are included."""
    config = config or Config(vendor_dirs=(".git", "node_modules"), skip_composer_dirs=False)
    done = analyze(files, config)
    return report.verify_targets(targets, done.endpoints, done.reachable_files())


def reachability_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("total"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("not_reachable"), F.count_if("direct_match").alias("endpoints_found"))


def register(spark: SparkSession, done: Analysis) -> None:
    """Views ``endpoints``, ``plugins``, ``calls``, ``functions``, ``classes`` and SQL functions of the engine."""
    from ..functions import auth
    from ..php import lexer

    for name in ("endpoints", "plugins"):
        getattr(done, name).createOrReplaceTempView(name)
    for name in ("calls", "functions", "classes", "symbols", "includes"):
        getattr(done.facts, name).createOrReplaceTempView(name)

    # texts of any length go to Python a hundred at a time, not in batches of ten thousand

    @F.udf("string", useArrow=False)
    def php_strip_comments(x):
        return None if x is None else lexer.strip_comments(x)

    @F.udf("int", useArrow=False)
    def php_auth_level(x):
        return 0 if x is None else auth.infer_level(x, Config())

    spark.udf.register("php_strip_comments", php_strip_comments)
    spark.udf.register("php_auth_level", php_auth_level)

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION php_line_of(code STRING, off INT) RETURNS INT RETURN length(left(code, off)) - length(replace(left(code, off), chr(10), '')) + 1")
    for name, handler in (("php_calls", PhpCalls), ("php_functions", PhpFunctions)):
        spark.udtf.register(name, F.udtf(handler, returnType=handler.RETURNS))
    spark.udtf.register("auth_fold", F.udtf(AuthFold))


class PhpCalls:
    """Calls of a text: ``LATERAL php_calls(content)``."""

    RETURNS = "callee string, line int, vals array<string>"

    def eval(self, content: str):
        from ..php.facts import File

        for c in File(content or "").calls:
            yield c["callee"], c["line"], c["vals"]


class PhpFunctions:
    """Functions of a text with the level that their bodies ask for and what they call: ``LATERAL php_functions(content)``."""

    RETURNS = "class string, name string, line int, params array<string>, level int, calls array<string>"

    def eval(self, content: str):
        from ..php.facts import facts

        for f in facts(content or "")["functions"]:
            yield f["class_fqn"], f["name"], f["line"], f["params"], f["level"], f["calls"]


class AuthFold:
    """The dedup fold over any table with the columns auth_level and callback, in the order of the call; its columns are the table's.

    ``SELECT * FROM auth_fold(TABLE(endpoints) PARTITION BY (plugin_slug, route, method, type) ORDER BY (file, callback))``
    """

    def __init__(self):
        self.best = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"auth_level", "callback"} <= set(rows.dataType.names):
            raise ValueError("auth_fold takes a table with the columns auth_level and callback")
        return AnalyzeResult(schema=rows.dataType)

    def eval(self, row: Row):
        state = lambda r: (r["auth_level"], r["callback"] in W.GENERIC_CALLBACKS)
        if self.best is None or fold.replaces(state(self.best), state(row)):
            self.best = row

    def terminate(self):
        if self.best is not None:
            yield tuple(self.best)


def level_names(endpoints: DataFrame) -> DataFrame:
    return endpoints.withColumn("level_name", R.level_name(F.col("auth_level")))


def run(spark: SparkSession, pages_url: str, info_url: str, max_pages: int = 0, max_plugins: int = 0, client: remote.Client | None = None, config: Config | None = None) -> tuple[Analysis, DataFrame]:
    """Fetch a listing, details and archives, then analyse: the analysis, and the downloads with their errors.

    ``pages_url`` holds ``{page}``, ``info_url`` ``{slug}``. Pages, details and archives are read in tasks; archives are
    written once to the shared folder, since both the files and the errors come from them.
    """
    client = client or remote.Client()
    spark.dataSource.register(remote.PagesSource)
    pages = spark.read.format("http_pages").option("url", pages_url).option("max_pages", max_pages).option("attempts", client.attempts).option("base", client.base).option("timeout", client.timeout).load()
    pages = _kept(pages.select("page", F.col("body").cast("string").alias("html")), "pages")
    listed = _kept(corpus.popular(pages, max_pages), "listed")
    found = remote.details(listed, info_url, max_plugins, client)
    wanted = corpus.plugin_info(found.select("json")).select("slug", "download_link").where("download_link <> ''").repartition("slug")
    zips = _kept(remote.archives(wanted, client), "archives")
    return analyze(corpus.unzip(zips.where("error is null")), config), zips.select("plugin_slug", "error")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written once, so that no request is sent twice."""
    path = f"{shared_dir(df.sparkSession)}/plugscope/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
