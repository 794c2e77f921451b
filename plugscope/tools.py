"""Registered queries of sources, sinks, configuration, validation, reachability and streaming, with SQL."""

from __future__ import annotations

import io
import json
import urllib.error
import urllib.response
import uuid
import zipfile
from collections.abc import Callable
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Profile, load_config
from .functions import auth
from .functions import rules as R
from .operators import detect, dispatch, graph, report
from .plans import analyze as plans
from .plans.facts import build, shared_dir
from .sources import corpus, remote, sinks
from .streaming import incremental

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
HOOKED = "add_action('wp_ajax_nopriv_a@', 'f@'); function f@() { g@(); } function g@() { return 1; }"


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("k", F.col("s_suppkey").cast("string")).withColumn("slug", F.concat(F.lit("n"), "s_nationkey"))


def _code(text: str):
    return F.replace(F.lit(f"<?php\n{text}"), F.lit("@"), F.col("k")).cast("binary")


def _files(spark: SparkSession, sf_dir: str, *made: tuple[str, str]) -> DataFrame:
    """Files (name, code) of each supplier; ``@`` is its key."""
    rows = [F.struct(F.replace(F.lit(name), F.lit("@"), F.col("k")).alias("file"), _code(text).alias("content")) for name, text in made]
    return _supplier(spark, sf_dir).withColumn("r", F.explode(F.array(*rows))).select(F.col("slug").alias("plugin_slug"), "r.*")


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint rows of all types, straight from suppliers."""
    s, n = _supplier(spark, sf_dir), F.col("s_suppkey")
    types = F.element_at(F.array(*map(F.lit, ["rest", "ajax", "admin", "shortcode"])), (n % 4 + 1).cast("int"))
    return s.select(F.col("slug").alias("plugin_slug"), types.alias("type"), F.concat(F.lit("/r"), "k").alias("route"), F.when(n % 4 == 0, "POST").otherwise("").alias("method"), (n % 7).cast("int").alias("auth_level"), F.when(n % 3 == 0, "unknown").otherwise(F.concat(F.lit("cb"), "k")).alias("callback"), F.concat(F.lit("s"), "k", F.lit(".php")).alias("file"), n.cast("int").alias("line"), F.when(n % 4 == 3, "[GET:x]").otherwise("").alias("raw_code"), F.lit("").alias("namespace"))


_ENDPOINT_SQL = """(SELECT 'n' || s_nationkey AS plugin_slug, ['rest', 'ajax', 'admin', 'shortcode'][CAST(s_suppkey % 4 + 1 AS INTEGER)] AS type, '/r' || s_suppkey AS route, CASE WHEN s_suppkey % 4 = 0 THEN 'POST' ELSE '' END AS method, CAST(s_suppkey % 7 AS INTEGER) AS auth_level,
CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'cb' || s_suppkey END AS callback, 's' || s_suppkey || '.php' AS file, CAST(s_suppkey AS INTEGER) AS line, CASE WHEN s_suppkey % 4 = 3 THEN '[GET:x]' ELSE '' END AS raw_code FROM supplier)"""
_LEVEL = "['unauthenticated', 'subscriber', 'contributor', 'author', 'editor', 'admin', 'superadmin'][auth_level + 1]"


# Sources


@_query(
    """SELECT scan, dir || s_suppkey AS file FROM supplier, (VALUES ('analysis', 'a/x', true), ('analysis', 'redux-core/x', false), ('analysis', 'vendor/x', false), ('analysis', 'Vendor/x', true), ('analysis', 'views/x', true),
('wrappers', 'a/x', true), ('wrappers', 'redux-core/x', true), ('wrappers', 'vendor/x', false), ('wrappers', 'Vendor/x', true), ('wrappers', 'views/x', true), ('ast', 'a/x', true), ('ast', 'redux-core/x', true), ('ast', 'vendor/x', false), ('ast', 'Vendor/x', false), ('ast', 'views/x', true),
('direct', 'a/x', true), ('direct', 'redux-core/x', true), ('direct', 'vendor/x', false), ('direct', 'Vendor/x', true), ('direct', 'views/x', false), ('reachability', 'a/x', true), ('reachability', 'redux-core/x', true), ('reachability', 'vendor/x', true), ('reachability', 'Vendor/x', true), ('reachability', 'views/x', true)) v(scan, dir, kept) WHERE kept"""
)
def corpus_scans(spark, sf_dir):
    """The directories that each scan skips."""
    files = _files(spark, sf_dir, *[(f"{d}/x@.php", "") for d in ("a", "redux-core", "vendor", "Vendor", "views")])
    found = [corpus.php_files(files, scan=scan).select(F.lit(scan).alias("scan"), F.regexp_replace("file", r"\.php$", "").alias("file")) for scan in corpus.PRUNE]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@_query("SELECT 'plugin_slug=n' || s_nationkey AS plugin_slug, CAST(sum(length('row ' || s_suppkey) + 1) AS BIGINT) AS n_bytes FROM supplier GROUP BY s_nationkey")
def corpus_directory(spark, sf_dir):
    """A directory of plugins, each a sub-directory, read back whole."""
    path = f"{shared_dir(spark)}/plugscope/corpus-{uuid.uuid4().hex}"
    _supplier(spark, sf_dir).select(F.col("slug").alias("plugin_slug"), F.concat(F.lit("row "), "k").alias("value")).write.partitionBy("plugin_slug").text(path)
    return corpus.read_corpus(spark, path).where("file like '%.txt'").groupBy("plugin_slug").agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@_query("SELECT kind, max(CASE WHEN kind = 'some' THEN s_suppkey % 7 = 0 ELSE kind = 'every' END) AS single FROM supplier, (VALUES ('every'), ('some'), ('none'), ('nested')) v(kind) GROUP BY kind")
def single_plugin(spark, sf_dir):
    """Whether any file at the root of a directory has a plugin header: all, some, none, or only nested ones have."""
    head = _code("/*\n * Plugin Name: X\n */")
    made = lambda name, has: _supplier(spark, sf_dir).select(F.col("slug").alias("plugin_slug"), F.replace(F.lit(name), F.lit("@"), F.col("k")).alias("file"), F.when(has, head).otherwise(F.lit(b"<?php")).alias("content"))
    cases = {"every": made("a@.php", F.lit(True)), "some": made("a@.php", F.col("s_suppkey") % 7 == 0), "none": made("a@.php", F.lit(False)), "nested": made("b/c@.php", F.lit(True))}
    out = [corpus.is_single_plugin(files).select(F.lit(kind).alias("kind"), "single") for kind, files in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@_query("SELECT 'z' || s_suppkey AS plugin_slug, f AS file, CAST(length(f || s_suppkey) AS INTEGER) AS n_bytes FROM supplier, (VALUES ('main.php'), ('inc/b.php')) v(f) WHERE s_suppkey % 5 <> 0")
def zip_extract(spark, sf_dir):
    """Entries of archives; those that leave the archive, directories and broken archives give no row."""

    def packed(batches):
        for pdf in batches:
            out = []
            for k in pdf["k"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name in ("plugin/main.php", "plugin/inc/b.php", "plugin/../../evil.php", "/etc/abs.php"):
                        z.writestr(name, name.removeprefix("plugin/") + k)
                    z.writestr("plugin/dir/", "")
                out.append((f"z{k}", held.getvalue() if int(k) % 5 else b"broken"))
            yield pd.DataFrame(out, columns=["plugin_slug", "content"])

    zips = _supplier(spark, sf_dir).select("k").mapInPandas(packed, "plugin_slug string, content binary")
    return corpus.unzip(zips).select("plugin_slug", "file", F.octet_length("content").alias("n_bytes"))


class _Scripted:
    """A client of one attempt whose answers are in the URL: ``script:<key>:<code>,<code>,...``; its attempts are counted by URL in the task."""

    asked: dict[str, int] = {}

    def __call__(self, url: str, timeout: float):
        codes = url.rpartition(":")[2].split(",")
        n = self.asked[url] = self.asked.get(url, 0) + 1
        code = int(codes[min(n, len(codes)) - 1])
        if code != 200:
            raise urllib.error.HTTPError(url, code, "", Message(), io.BytesIO())
        return urllib.response.addinfourl(io.BytesIO(url.encode()), Message(), url, 200)


@_query(
    """SELECT s_suppkey, CAST([1, 2, 3, 1, 3][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS INTEGER) AS attempts, CASE WHEN s_suppkey % 5 < 3 THEN 200 WHEN s_suppkey % 5 = 3 THEN 404 END AS status,
CASE s_suppkey % 5 WHEN 3 THEN 'status 404' WHEN 4 THEN 'status 503' END AS error FROM supplier"""
)
def retry_policy(spark, sf_dir):
    """URLs of a table read in tasks: attempts until another status than a passing failure, or until none is left."""
    codes = F.element_at(F.array(*map(F.lit, ["200", "503,200", "429,502,200", "404", "503"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    urls = _supplier(spark, sf_dir).select("s_suppkey", F.concat_ws(":", F.lit("script"), F.expr("uuid()"), codes).alias("url"))
    client = remote.Client(attempts=3, base=0, opener=_Scripted)
    return remote.fetch(urls, client).select("s_suppkey", "attempts", "status", "error")


@_query("SELECT 'r' || r_regionkey || 'p' || p AS slug, CAST(row_number() OVER (ORDER BY r_regionkey, p) - 1 AS INTEGER) AS pos FROM region, (VALUES (0), (1), (2)) v(p) WHERE r_regionkey < 3 ORDER BY pos LIMIT 8")
def popular_crawl(spark, sf_dir):
    """A listing's slugs in order of first occurrence, up to a number of pages and of plugins."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    key = F.col("r_regionkey").cast("string")
    anchors = [F.concat(F.lit('<a href="/plugins/r'), key, F.lit(f'p{p}/">')) for p in (0, 1, 2, 0)]
    html = F.concat(*anchors, F.lit('<a href="/plugins/browse/"><a href="/page/5/">'), F.lit('<a href="/plugins/r0p1/">'))
    return corpus.popular(r.select((F.col("r_regionkey") + 1).alias("page"), html.alias("html")), 3, 8)


@_query("SELECT '/srv/plugins/n' || s_nationkey || '/inc/f' || s_suppkey || '.php' AS full_path, 'n' || s_nationkey AS plugin_dir, 'inc/f' || s_suppkey || '.php' AS relative_path, 'CVE-' || s_suppkey AS cve FROM supplier WHERE s_suppkey % 3 <> 0")
def targets_tsv(spark, sf_dir):
    """Targets of a tab-separated file: status FOUND, header and short lines skipped."""
    path = f"{shared_dir(spark)}/plugscope/targets-{uuid.uuid4().hex}"
    rel = F.concat(F.lit("inc/f"), "k", F.lit(".php"))
    cols = [F.when(F.col("s_suppkey") % 3 == 0, "MISSING").otherwise("FOUND"), F.concat(F.lit("/srv/plugins/"), "slug", F.lit("/"), rel), F.col("slug"), F.lit("1.0"), rel, F.concat(F.lit("CVE-"), "k"), F.lit("a"), F.lit("b"), F.lit("c")]
    rows = _supplier(spark, sf_dir).select(F.concat_ws("\t", *cols).alias("value"))
    rows.unionByName(spark.createDataFrame([("status\tfull_path",), ("FOUND\tshort",)], "value string")).write.text(path)
    return corpus.targets_tsv(spark, path).select("full_path", "plugin_dir", "relative_path", "cve")


@_query("SELECT s_suppkey, 'Name ' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN '6.1' ELSE '' END AS requires, CAST(s_suppkey * 10 AS BIGINT) AS active_installs, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_tags FROM supplier")
def plugin_info(spark, sf_dir):
    """Plugin information of API responses, with strings that may be false and maps that may be lists."""
    text = F.concat(F.lit('{"slug":"'), "k", F.lit('","name":"Name '), "k", F.lit('","requires":'), F.when(F.col("s_suppkey") % 2 == 0, '"6.1"').otherwise("false"), F.lit(',"active_installs":'), (F.col("s_suppkey") * 10).cast("string"), F.lit(',"tags":'), F.when(F.col("s_suppkey") % 3 == 0, "[]").otherwise('{"a":"b"}'), F.lit("}"))
    return corpus.plugin_info(_supplier(spark, sf_dir).select(text.alias("json"))).select(F.col("slug").cast("long").alias("s_suppkey"), "name", "requires", "active_installs", F.size("tags").alias("n_tags"))


@_query("SELECT s_suppkey, s_suppkey % 2 = 0 AS is_binary, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 0 END AS n_bom FROM supplier")
def special_files(spark, sf_dir):
    """Files with a NUL byte in front, and files with a byte order mark."""
    n = F.col("s_suppkey")
    content = F.concat(F.when(n % 3 == 0, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")), F.lit(b"<?php"), F.when(n % 2 == 0, F.lit(b"\x00")).otherwise(F.lit(b" ")))
    return _supplier(spark, sf_dir).withColumn("c", content).select("s_suppkey", corpus.is_binary(F.col("c")).alias("is_binary"), (F.octet_length("c") - F.octet_length(corpus.without_bom(F.col("c")))).alias("n_bom"))


# Configuration


@_query(
    """SELECT s_suppkey, CAST([4, 5, 3, 1, 5][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS INTEGER) AS cap_level, CAST([0, 5, 5, 1, 1][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS INTEGER) AS route_level FROM supplier"""
)
def config_merge(spark, sf_dir):
    """JSON over the defaults: maps overlay, lists append; an enabled profile brings its namespaces, a disabled one does not."""
    config = load_config(json.dumps({"custom": {"own_cap": "editor", "read": "admin"}, "extended": {"own_cap": "admin", "shop_cap": "author"}, "rest_public": ["/open/"]}))
    config = config.add_profile("on", Profile(True, "On", admin_rest_namespaces=("boss/",))).add_profile("off", Profile(False, "Off", admin_rest_namespaces=("staff/",)))
    n = F.col("s_suppkey") % 5
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n + 1).cast("int"))
    cap, space, route = pick("own_cap", "read", "shop_cap", "level_0", "manage_options"), pick("a/v1", "boss/v1", "a/v1", "staff/v1", "a/v1"), pick("/open/x", "/x", "/settings/x", "/x", "/x")
    level = R.route_level(route, space, F.lit(1), F.lit(False), config)
    return _supplier(spark, sf_dir).select("s_suppkey", R.capability_level(cap, config).cast("int").alias("cap_level"), level.cast("int").alias("route_level"))


@_query("SELECT p_partkey, starts_with(n, 'can_') OR contains(n, 'check_permission') OR ends_with(n, '_capability') AS hit FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'can_' WHEN 1 THEN 'check_permission_' ELSE 'get_' END || p_size || CASE WHEN p_partkey % 4 = 2 THEN '_capability' ELSE '' END AS n FROM part)")
def permission_names(spark, sf_dir):
    """Names that speak of permissions."""

    @F.pandas_udf("boolean")
    def named(names: pd.Series) -> pd.Series:
        return names.map(auth.is_permission_name)

    k = F.col("p_partkey") % 4
    name = F.concat(F.when(k == 0, "can_").when(k == 1, "check_permission_").otherwise("get_"), "p_size", F.when(k == 2, "_capability").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", named(name).alias("hit"))


@_query("SELECT p_partkey, contains(lower(p_type), 'promo') OR contains(lower(p_type), 'brass') AS hit FROM part")
def contains_without_case(spark, sf_dir):
    """Words anywhere in a text, whatever the case."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", R.contains_any(F.lower("p_type"), ["promo", "brass"]).alias("hit"))


@_query(
    r"""SELECT doc_id, CASE WHEN strlen(t) > 100 THEN left(t, list_max(list_filter(range(0, 101), lambda k: strlen(left(t, CAST(k AS INTEGER))) <= 100))) || '...' ELSE t END AS code
FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM documents)"""
)
def truncate_code(spark, sf_dir):
    """Code with single spaces, cut to whole characters within a number of bytes."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", R.collapse(F.col("text"), 100).alias("code"))


# Sinks


@_query(
    f"""WITH e AS {_ENDPOINT_SQL} SELECT auth_level, CAST(1 AS INTEGER) AS kind, CASE type WHEN 'rest' THEN CASE WHEN method = '' THEN 'GET' ELSE method END || ' ' || route ELSE CASE type WHEN 'ajax' THEN 'AJAX ' WHEN 'admin' THEN 'ADMIN ' ELSE 'SHORTCODE ' END || route END || CASE WHEN callback = 'unknown' THEN '' ELSE ' -> ' || callback END || CASE WHEN type = 'shortcode' THEN ' [GET:x]' ELSE '' END AS text FROM e
UNION ALL SELECT auth_level, 0, CASE auth_level WHEN 6 THEN 'SUPER ADMIN' ELSE upper({_LEVEL}) END || ' ENDPOINTS (' || count(*) || ')' FROM e GROUP BY auth_level"""
)
def text_report(spark, sf_dir):
    """The text report's titles and lines."""
    return sinks.text_lines(_endpoints(spark, sf_dir))


@_query(
    f"""WITH e AS {_ENDPOINT_SQL} SELECT plugin_slug, type, route, CASE WHEN method <> '' THEN method END AS method, {_LEVEL} AS auth_level, callback, file, CAST(line AS INTEGER) AS line, CASE WHEN raw_code <> '' THEN raw_code END AS raw_code FROM e"""
)
def json_report(spark, sf_dir):
    """JSON of endpoints, an object a row, read back; empty optional fields are absent."""
    text = report.as_json(_endpoints(spark, sf_dir))
    return text.select(F.from_json("json", "plugin_slug string, type string, route string, method string, auth_level string, callback string, file string, line int, raw_code string").alias("r")).select("r.*")


def _path_rows(spark, sf_dir):
    k = F.col("k")
    name = lambda x: F.concat(F.lit(x), k)
    return _supplier(spark, sf_dir).select("s_suppkey", F.array(F.array(name("a")), F.array(name("a"), name("b")), F.array(name("a"), name("c")), F.array(name("d"))).alias("paths"))


@_query("SELECT s_suppkey, replace('├── a@' || chr(10) || '│   ├── b@' || chr(10) || '│   └── c@' || chr(10) || '└── d@', '@', CAST(s_suppkey AS VARCHAR)) AS tree FROM supplier")
def tree_text(spark, sf_dir):
    """Call paths as a drawn tree."""
    return _path_rows(spark, sf_dir).select("s_suppkey", sinks.tree_column(F.col("paths")).alias("tree"))


@_query("""SELECT s_suppkey, replace('[{"function": "a@", "calls": [{"function": "b@"}, {"function": "c@"}]}, {"function": "d@"}]', '@', CAST(s_suppkey AS VARCHAR)) AS chain FROM supplier""")
def chain_json(spark, sf_dir):
    """Call paths as nested JSON."""
    return _path_rows(spark, sf_dir).select("s_suppkey", sinks.chain_column(F.col("paths")).alias("chain"))


@_query(f"SELECT {_LEVEL} AS level, CAST(count(*) AS INTEGER) AS n, CAST(max((SELECT count(*) FROM supplier)) AS INTEGER) AS total FROM {_ENDPOINT_SQL} GROUP BY auth_level")
def full_report(spark, sf_dir):
    """The whole report as lines of one JSON document, written and read back: endpoints by level and the summary."""
    e = _endpoints(spark, sf_dir)
    lines = sinks.full_report_lines(e, e.select("plugin_slug").distinct(), report.summary(e))
    path = f"{shared_dir(spark)}/plugscope/report-{uuid.uuid4().hex}"
    sinks.write_lines(lines, path)
    read = spark.read.text(path).withColumn("json", F.regexp_replace("value", "^,", ""))
    found = read.where(F.get_json_object("json", "$.route").isNotNull()).groupBy(F.get_json_object("json", "$.auth_level").alias("level")).agg(F.count("*").cast("int").alias("n"))
    total = read.select(F.get_json_object("json", "$.total_endpoints").cast("int").alias("total")).where("total is not null")
    return found.join(F.broadcast(total))  # one row


@_query("SELECT rpad('n' || s_nationkey, 40, ' ') || ' ' || rpad('Plugin with a rather long name that...', 38, ' ') || ' 1.' || s_nationkey AS line FROM (SELECT DISTINCT s_nationkey FROM supplier)")
def plugin_list(spark, sf_dir):
    """Slugs, names cut at a width, and versions."""
    p = _supplier(spark, sf_dir).select(F.col("slug").alias("plugin_slug"), F.lit("Plugin with a rather long name that does not fit").alias("name"), F.concat(F.lit("1."), "s_nationkey").alias("version")).distinct()
    return sinks.plugin_lines(p).select("line")


@_query(
    """SELECT 'n' || s_nationkey AS plugin_slug, 'f' || s_suppkey || '.php' AS relative_path, s_suppkey % 2 = 0 AS reachable, t.total, t.reached FROM supplier, (SELECT CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (s_suppkey % 2 = 0) AS INTEGER) AS reached FROM supplier) t"""
)
def reachability_report(spark, sf_dir):
    """Verified targets as lines of one JSON document, written and read back: the summary and every result."""
    s = _supplier(spark, sf_dir)
    even = F.col("s_suppkey") % 2 == 0
    targets = s.select(F.col("slug").alias("plugin_slug"), F.concat(F.lit("f"), "k", F.lit(".php")).alias("relative_path"))
    ends = s.where(even).select(F.col("slug").alias("plugin_slug"), F.lit("rest").alias("type"), F.lit("/r").alias("route"), F.concat(F.lit("inc/f"), "k", F.lit(".php")).alias("file"))
    verified = report.verify_targets(targets, ends, ends.select("plugin_slug", "file"))
    path = f"{shared_dir(spark)}/plugscope/verified-{uuid.uuid4().hex}"
    sinks.write_lines(sinks.reachability_lines(verified), path)
    read = spark.read.text(path).withColumn("json", F.regexp_replace("value", "^,", ""))
    one = lambda c, t="string": F.get_json_object("json", f"$.{c}").cast(t).alias(c)
    rows = read.where(F.get_json_object("json", "$.relative_path").isNotNull()).select(one("plugin_slug"), one("relative_path"), one("reachable", "boolean"))
    summary = read.where(F.get_json_object("json", "$.not_reachable").isNotNull()).select(one("total", "int"), F.get_json_object("json", "$.reachable").cast("int").alias("reached"))
    return rows.join(F.broadcast(summary))  # one row


@_query(f"SELECT plugin_slug, route, CAST(row_number() OVER (PARTITION BY plugin_slug ORDER BY route, method, type, file, callback) AS INTEGER) AS pos FROM {_ENDPOINT_SQL}")
def endpoint_order(spark, sf_dir):
    """Endpoints of a plugin in their order: route, method, type, file, callback."""
    return report.in_order(_endpoints(spark, sf_dir)).select("plugin_slug", "route", "pos")


# Summaries, coverage, validation


@_query("SELECT 'n' || s_nationkey AS plugin_slug, CAST(2 * count(*) AS BIGINT) AS files_analyzed, CAST(count(*) FILTER (s_suppkey % 2 = 0) AS INTEGER) AS n_errors FROM supplier GROUP BY s_nationkey")
def plugin_files(spark, sf_dir):
    """Files of each plugin, and those that cannot be parsed."""
    bad = F.when(F.col("s_suppkey") % 2 == 0, F.lit(b"<?php \x00")).otherwise(F.lit(b"<?php echo 1;"))
    rows = _supplier(spark, sf_dir)
    files = rows.select(F.col("slug").alias("plugin_slug"), F.concat(F.lit("a"), "k", F.lit(".php")).alias("file"), bad.alias("content"))
    files = files.unionByName(rows.select(F.col("slug").alias("plugin_slug"), F.concat(F.lit("b"), "k", F.lit(".php")).alias("file"), F.lit(b"<?php echo 2;").alias("content")))
    return plans.analyze(files).plugins.select("plugin_slug", "files_analyzed", F.size("errors").alias("n_errors"))


@_query("SELECT 'n' || s_nationkey AS plugin_slug, CAST(2 * count(*) AS BIGINT) AS total_rest_calls, CAST(count(*) AS BIGINT) AS gaps, CAST(count(*) AS BIGINT) AS detected FROM supplier GROUP BY s_nationkey")
def coverage_totals(spark, sf_dir):
    """Registrations of each plugin, with and without an endpoint."""
    facts = build(_files(spark, sf_dir, ("s@.php", "register_rest_route('a/v1', '/b@', ['callback' => 'c', 'permission_callback' => '__return_true']);\n\n\n\n\n\nregister_rest_route($a, $b, $c);")))
    return report.coverage(detect.rest(facts), facts.calls)


@_query("SELECT 'n' || s_nationkey AS plugin_slug, p || s_suppkey || '.php' AS relative_path, p = 'main' AS direct_match, p <> 'lib/dead' AS reachable FROM supplier, (VALUES ('main'), ('inc/used'), ('lib/dead')) v(p)")
def reachability_verdicts(spark, sf_dir):
    """Targets with direct and reachable matches."""
    files = _files(spark, sf_dir, ("main@.php", HOOKED + " require __DIR__ . '/inc/used@.php';"), ("inc/used@.php", "echo 1;"), ("lib/dead@.php", "class Dead@ {}"))
    targets = files.select("plugin_slug", F.col("file").alias("relative_path"))
    return plans.verify_reachability(files, targets).select("plugin_slug", "relative_path", "direct_match", "reachable")


@_query("SELECT count(*) AS total, count(*) FILTER (s_suppkey % 3 <> 0) AS reachable, count(*) FILTER (s_suppkey % 3 = 0) AS not_reachable, count(*) FILTER (s_suppkey % 3 = 1) AS endpoints_found FROM supplier")
def reachability_summary(spark, sf_dir):
    n = F.col("s_suppkey") % 3
    return plans.reachability_summary(_supplier(spark, sf_dir).select((n != 0).alias("reachable"), (n == 1).alias("direct_match")))


def _matched(spark, sf_dir):
    n = F.col("s_suppkey")
    return _supplier(spark, sf_dir).select(F.col("slug").alias("plugin_slug"), F.when(n % 2 == 0, "rest").otherwise("ajax").alias("type"), F.concat(F.lit("/a/"), "k").alias("route"), F.when(n % 3 != 0, F.concat(F.lit("/d/"), "k")).alias("matched"))


@_query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'rest' ELSE 'ajax' END AS type, count(*) AS total, count(*) FILTER (s_suppkey % 3 <> 0) AS detected, 100.0 * count(*) FILTER (s_suppkey % 3 <> 0) / count(*) AS coverage FROM supplier GROUP BY 1")
def validation_coverage(spark, sf_dir):
    """Coverage by type."""
    return report.validation_metrics(_matched(spark, sf_dir))


@_query("SELECT correct, wrong, 100.0 * correct / (correct + wrong) AS accuracy FROM (SELECT count(*) FILTER (s_suppkey % 5 <> 0) AS correct, count(*) FILTER (s_suppkey % 5 = 0) AS wrong FROM supplier WHERE s_suppkey % 3 <> 0)")
def auth_accuracy(spark, sf_dir):
    """Levels of matched routes against the truth."""
    m = _matched(spark, sf_dir)
    detected = _supplier(spark, sf_dir).select(F.col("slug").alias("plugin_slug"), F.when(F.col("s_suppkey") % 2 == 0, "rest").otherwise("ajax").alias("type"), F.concat(F.lit("/d/"), "k").alias("route"), F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(5).alias("auth_level"))
    return report.auth_accuracy(m, m.withColumn("level", F.lit("admin")), detected)


@_query("SELECT 'n' || s_nationkey AS plugin_slug, count(*) AS total, count(*) FILTER (s_suppkey % 3 <> 0) AS found, 100.0 * count(*) FILTER (s_suppkey % 3 <> 0) / count(*) AS coverage FROM supplier GROUP BY s_nationkey ORDER BY coverage, total DESC, plugin_slug LIMIT 10")
def worst_plugins(spark, sf_dir):
    """The ten plugins with the least coverage, a report's limit."""
    return report.worst_plugins(_matched(spark, sf_dir))


@_query("SELECT 'n' || s_nationkey AS plugin_slug, CASE WHEN s_suppkey % 2 = 0 THEN 'rest' ELSE 'ajax' END AS type, '/d/' || s_suppkey AS route FROM supplier WHERE s_suppkey % 3 = 0")
def extra_detected(spark, sf_dir):
    """Detected routes that no manual row matched."""
    m = _matched(spark, sf_dir)
    return report.extra_detected(m, m.withColumn("route", F.regexp_replace("route", "^/a/", "/d/")))


@_query("SELECT 'p' || s_nationkey AS plugin_slug, CAST(max(s_suppkey % 7) AS INTEGER) AS top, CAST(min(s_suppkey % 7) AS INTEGER) AS least FROM supplier GROUP BY s_nationkey")
def level_bounds(spark, sf_dir):
    """The highest and the lowest level of each plugin."""
    e = _endpoints(spark, sf_dir)
    return report.level_bounds(e).withColumn("plugin_slug", F.regexp_replace("plugin_slug", "^n", "p"))


# Graphs


@_query("SELECT 'n' || s_nationkey AS plugin_slug, CAST(2 * count(*) AS BIGINT) AS n_functions, CAST(count(*) AS BIGINT) AS n_edges FROM supplier GROUP BY s_nationkey")
def call_graph_stats(spark, sf_dir):
    """Functions and calls between them, of each plugin."""
    functions = build(_files(spark, sf_dir, ("s@.php", HOOKED))).functions
    edges = graph.call_edges(functions).groupBy("plugin_slug").agg(F.count("*").alias("n_edges"))
    return functions.groupBy("plugin_slug").agg(F.count("*").alias("n_functions")).join(edges, "plugin_slug", "left")


@_query("SELECT 'n' || s_nationkey AS plugin_slug, 'views/v' || s_suppkey || '.php' AS file FROM supplier UNION ALL SELECT 'n' || s_nationkey, 'main' || s_suppkey || '.php' FROM supplier")
def dynamic_includes(spark, sf_dir):
    """Includes with a variable open the directory they name."""
    facts = build(_files(spark, sf_dir, ("main@.php", HOOKED + " include __DIR__ . 'views/' . $page . '.php';"), ("views/v@.php", "echo 1;"), ("lib/w@.php", "echo 2;")))
    return graph.reachable_files(facts, detect.ajax(facts))


_LOADER = """class L@ { private $dir; function tpl($n) { $path = $this->dir . '/views/' . $n . '.php'; include $path; } function show($page) { $this->tpl($page); } }
function part@($a, $name) { include "parts/$name"; } function plain@($x) { return $x; }"""
_ASKING = "function go@() { $l = new L@(); $l->show('alpha@'); part@('beta@', 'gamma@'); plain@('delta@'); L@::tpl($unknown); } add_action('wp_ajax_nopriv_q@', 'go@');"
_VIEWS = [("views/alpha@.php", "echo 1;"), ("other/alpha@.php", "echo 2;"), ("parts/gamma@.html.php", "echo 3;"), ("beta@.php", "echo 4;"), ("x/delta@.php", "echo 5;")]


@_query("SELECT 'n' || s_nationkey AS plugin_slug, 'inc/main' || s_suppkey || '.php' AS src, a || s_suppkey AS arg, d || s_suppkey || e AS dst FROM supplier, (VALUES ('alpha', 'views/alpha', '.php'), ('gamma', 'parts/gamma', '.html.php')) v(a, d, e)")
def argument_includes(spark, sf_dir):
    """Literal arguments that end up in an include's path, also handed on by another function, name their files: ranked by directory, with endings added."""
    facts = build(_files(spark, sf_dir, ("inc/loader@.php", _LOADER), ("inc/main@.php", _ASKING), *_VIEWS))
    return dispatch.argument_includes(facts, dispatch.resolved(facts)).select("plugin_slug", "src", "arg", "dst")


@_query("SELECT 'n' || s_nationkey AS plugin_slug, 'go' || s_suppkey AS callback, f || s_suppkey || e AS reached FROM supplier, (VALUES ('inc/main', '.php'), ('inc/loader', '.php'), ('views/alpha', '.php'), ('parts/gamma', '.html.php'), ('views/deep', '.php')) v(f, e)")
def callback_files(spark, sf_dir):
    """The files that a callback reaches: its own, those of what it calls, those that arguments name, and what these include."""
    views = [("views/alpha@.php", "include 'views/deep@.php';"), ("views/deep@.php", "echo 0;"), *_VIEWS[1:]]
    facts = build(_files(spark, sf_dir, ("inc/loader@.php", _LOADER), ("inc/main@.php", _ASKING), *views))
    return graph.callback_files(facts, detect.ajax(facts)).select("plugin_slug", "callback", "reached")


_AUTOLOAD = "spl_autoload_register('load@'); $base = __DIR__ . '/src@/'; class Own@ {}"
_REFERRED = "new Vendor\\Pack@\\Widget(); new Acme_Tool_Row@(); new Some_Kebab@(); new Lone@(); Own@::x(); new Gone@();"


@_query(
    r"""SELECT 'n' || s_nationkey AS plugin_slug, replace(r, '@', CAST(s_suppkey AS VARCHAR)) AS ref, replace(f, '@', CAST(s_suppkey AS VARCHAR)) AS file FROM supplier,
(VALUES ('Vendor\Pack@\Widget', 'lib@/src@/Pack@/Widget.php'), ('Acme_Tool_Row@', 'x@/Tool/Row@.php'), ('Some_Kebab@', 'k/some-kebab@.php'), ('Lone@', 'deep/down/Lone@.php'), ('Own@', 'lib@/auto.php')) v(r, f)"""
)
def class_file_ranks(spark, sf_dir):
    """Files of classes: declared, below an autoload directory with leading segments left out, the only base name, the longest ending, kebab names."""
    made = [("lib@/auto.php", _AUTOLOAD), ("main@.php", _REFERRED), ("lib@/src@/Pack@/Widget.php", ""), ("z@/Pack@/Widget.php", ""), ("x@/Tool/Row@.php", ""), ("y@/Row@.php", ""), ("k/some-kebab@.php", ""), ("deep/down/Lone@.php", "")]
    facts = build(_files(spark, sf_dir, *made))
    refs = facts.calls.where("receiver_kind in ('new', 'static')").select("plugin_slug", F.col("type").alias("ref"))
    return graph.class_files(facts.files.select("plugin_slug", "file"), facts.classes, refs, graph.autoload_dirs(facts))


@_query("SELECT 'n' || s_nationkey AS plugin_slug, 'lib' || s_suppkey || '/' || f || '.php' AS file FROM supplier, (VALUES ('auto'), ('src/any'), ('hooked')) v(f)")
def reachable_by_loader(spark, sf_dir):
    """Files below autoload directories are reachable, and those of callbacks whose hook begins like one that every request fires."""
    made = [("lib@/auto.php", "spl_autoload_register('f@'); $d = __DIR__ . '/src';"), ("lib@/src/any.php", "echo 1;"), ("lib@/hooked.php", "add_action('wp_ajax_' . $x, 'g@'); function g@() {}"), ("out@/none.php", "add_action('own_' . $x, 'h@'); function h@() {}")]
    facts = build(_files(spark, sf_dir, *made))
    return graph.reachable_files(facts, detect.direct_files(facts))


# Streaming and SQL functions


@_query("SELECT 'n' || s_nationkey AS plugin_slug, 'wp-admin/admin-ajax.php?action=a' || s_suppkey AS route, CAST(0 AS INTEGER) AS auth_level FROM supplier WHERE s_nationkey % 4 = 0")
def streaming_upsert(spark, sf_dir):
    """A stream of changed plugins: each is analysed again and replaced; a repeated batch changes nothing, and an emptied plugin keeps nothing."""
    base = f"{shared_dir(spark)}/plugscope/stream-{uuid.uuid4().hex}"
    whole = _files(spark, sf_dir, ("s@.php", HOOKED))
    nation = F.substring("plugin_slug", 2, 9).cast("int")
    changed = whole.select("plugin_slug").distinct().where(nation % 2 == 0)
    changed.write.parquet(f"{base}/changed")
    later = whole.withColumn("content", F.when(nation % 4 == 0, F.col("content")).otherwise(F.lit(b"<?php echo 1;")))
    for turn, now in (("first", whole), ("again", whole), ("emptied", later)):
        stream = spark.readStream.schema(changed.schema).parquet(f"{base}/changed")
        incremental.run(stream, lambda now=now: now, f"{base}/endpoints", f"{base}/{turn}").awaitTermination()
    return incremental.endpoints(spark, f"{base}/endpoints").select("plugin_slug", "route", "auth_level")


@_query("SELECT 'n' || s_nationkey AS plugin_slug, 'wp-admin/admin-ajax.php?action=a' || s_suppkey AS route, CAST(0 AS INTEGER) AS auth_level FROM supplier WHERE s_nationkey % 4 IN (0, 3) UNION ALL SELECT 'n' || s_nationkey, 'wp-admin/admin-ajax.php?action=b' || s_suppkey, 0 FROM supplier WHERE s_nationkey % 4 = 3")
def streaming_corpus(spark, sf_dir):
    """Drops of changed files: plugins that lose their endpoints, their files or all of themselves, gain files, or repeat what they have end as a full run leaves them."""
    base = f"{shared_dir(spark)}/plugscope/stream-{uuid.uuid4().hex}"
    s, kind = _supplier(spark, sf_dir), F.col("s_nationkey") % 4
    row = lambda drop, name, code, deleted: F.struct(F.lit(drop).cast("long").alias("drop"), F.col("slug").alias("plugin_slug"), F.replace(F.lit(name), F.lit("@"), F.col("k")).alias("file"), (F.lit(None).cast("binary") if code is None else _code(code)).alias("content"), F.lit(deleted).alias("deleted"))
    first, more = row(1, "s@.php", HOOKED, False), row(2, "t@.php", "add_action('wp_ajax_nopriv_b@', 'g');", False)
    second = F.when(kind == 1, F.array(row(2, "s@.php", "echo 1;", False))).when(kind == 2, F.array(row(2, "", None, True))).when(kind == 3, F.array(more, row(2, "s@.php", HOOKED, False))).otherwise(F.array(row(2, "s@.php", HOOKED, False)))
    for drop, made in ((1, F.array(first)), (2, second)):
        s.withColumn("r", F.explode(made)).select("r.*").write.parquet(f"{base}/drops/{drop}")
        stream = spark.readStream.schema(incremental.CHANGES).option("recursiveFileLookup", True).parquet(f"{base}/drops")
        incremental.maintain(stream, f"{base}/now", f"{base}/state").awaitTermination()
    return incremental.endpoints(spark, f"{base}/now/endpoints").select("plugin_slug", "route", "auth_level")


@_query("SELECT 'n' || s_nationkey AS plugin_slug, '/wp-json/n' || s_nationkey || '/v1/f' || s_suppkey AS route, 'GET' AS method, CAST(0 AS INTEGER) AS auth_level FROM supplier UNION ALL SELECT 'n' || s_nationkey, '/wp-json/n' || s_nationkey || '/v1/g' || s_suppkey, 'DELETE', 5 FROM supplier")
def rest_default_namespace(spark, sf_dir):
    """Short registrations in a file that names no namespace are below the plugin's own."""
    code = "class A { function go() { $this->register_route('/f@', ['callback' => 'f', 'permission_callback' => '__return_true']); self::register_route('/g@', 'cb', WP_REST_Server::DELETABLE); } }"
    return detect.rest(build(_files(spark, sf_dir, ("s@.php", code)))).select("plugin_slug", "route", "method", "auth_level")


@_query("SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS level, CAST(1 AS BIGINT) AS n_calls FROM supplier")
def sql_functions(spark, sf_dir):
    """The engine's functions in SQL: levels of code, comments, calls."""
    done = plans.Analysis(_endpoints(spark, sf_dir), _supplier(spark, sf_dir), build(_files(spark, sf_dir, ("s@.php", "x();"))))
    plans.register(spark, done)
    code = F.when(F.col("s_suppkey") % 3 == 0, "<?php current_user_can('manage_options');").when(F.col("s_suppkey") % 3 == 1, "<?php is_user_logged_in();").otherwise("<?php /* current_user_can('read') */ go();")
    _supplier(spark, sf_dir).select("s_suppkey", code.alias("code")).createOrReplaceTempView("snippets")
    return spark.sql("SELECT s_suppkey, php_auth_level(php_strip_comments(code)) AS level, count(*) AS n_calls FROM snippets, LATERAL php_calls(code) GROUP BY ALL")


@_query(
    """SELECT plugin_slug, route, method, type, max_by(CASE WHEN s_suppkey % 3 = 1 THEN 'unknown' ELSE 'cb' || s_suppkey END, r) AS callback, CAST(max_by(level, r) AS INTEGER) AS auth_level FROM (
SELECT *, CASE WHEN pub THEN 1000000 - s_suppkey ELSE level * 1000000 - s_suppkey END AS r FROM (SELECT 'n' || s_nationkey AS plugin_slug, '/r' || (s_suppkey % 2) AS route, 'GET' AS method, 'rest' AS type, s_suppkey, 0 AS level, s_suppkey % 3 <> 1 AS pub FROM supplier))
GROUP BY ALL"""
)
def sql_auth_fold(spark, sf_dir):
    """The fold as a table function over partitions: of public rows in order of file, the first whose callback says something, else the first."""
    s = _supplier(spark, sf_dir)
    plans.register(spark, plans.Analysis(_endpoints(spark, sf_dir), s, build(_files(spark, sf_dir, ("s@.php", "x();")))))
    said = F.when(F.col("s_suppkey") % 3 == 1, "unknown").otherwise(F.concat(F.lit("cb"), "k"))
    s.select(F.col("slug").alias("plugin_slug"), F.concat(F.lit("/r"), F.col("s_suppkey") % 2).alias("route"), F.lit("GET").alias("method"), F.lit("rest").alias("type"), F.col("s_suppkey").alias("file"), said.alias("callback"), F.lit(0).alias("auth_level")).createOrReplaceTempView("raw_endpoints")
    return spark.sql("SELECT plugin_slug, route, method, type, callback, auth_level FROM auth_fold(TABLE(raw_endpoints) PARTITION BY (plugin_slug, route, method, type) ORDER BY (file, callback))")


@_query("SELECT s_suppkey, unnest([{'name': 'go', 'line': 2, 'level': 5}, {'name': 'cb' || s_suppkey, 'line': 3, 'level': 0}], recursive := true), CAST(2 AS INTEGER) AS line_of FROM supplier")
def sql_php_functions(spark, sf_dir):
    """Functions of texts with lines and levels, and lines of places, in SQL."""
    s = _supplier(spark, sf_dir)
    plans.register(spark, plans.Analysis(_endpoints(spark, sf_dir), s, build(_files(spark, sf_dir, ("s@.php", "x();")))))
    code = F.concat(F.lit("<?php class A {\nfunction go() { current_user_can('manage_options'); }\nfunction cb"), "k", F.lit("() {} }"))
    s.select("s_suppkey", code.alias("code")).createOrReplaceTempView("methods")
    return spark.sql("SELECT s_suppkey, f.name, f.line, f.level, php_line_of(code, 20) AS line_of FROM methods, LATERAL php_functions(code) f")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
