"""Registered queries of the engine's operators, with equivalent SQL.

PHP corpora are made of table columns: each row gives a file, so the SQL side can derive the expected
rows from the same columns. Other operators run on the tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases, tools
from .config import Config, capability_dim
from .functions import rules as R
from .functions import words as W
from .operators import detect, graph, report
from .plans.facts import Facts, build
from .sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
LEVEL_SQL = "CASE {x} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(W.LEVELS)) + " END"
ADMIN_AJAX = "wp-admin/admin-ajax.php?action="


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(df: DataFrame, slug: Column, file: Column, *code) -> Facts:
    """A PHP file of each row, parsed into facts."""
    parts = [F.lit(c) if isinstance(c, str) else c.cast("string") for c in code]
    return build(df.select(slug.cast("string").alias("plugin_slug"), file.cast("string").alias("file"), F.concat(F.lit("<?php\n"), *parts).cast("binary").alias("content")))


def _supplier(spark: SparkSession, sf_dir: str, *code) -> Facts:
    df = _table(spark, sf_dir, "supplier")
    return _corpus(df, F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey", F.lit(".php")), *code)


def _nation(spark: SparkSession, sf_dir: str, *code) -> Facts:
    df = _table(spark, sf_dir, "nation")
    return _corpus(df, F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey", F.lit(".php")), *code)


def _key() -> Column:
    return F.col("s_suppkey")


SHORT = ["plugin_slug", "route", "method", "auth_level"]


@_query(
    f"""SELECT 'n' || s_nationkey AS plugin_slug, '{ADMIN_AJAX}act' || s_suppkey AS route, 'POST' AS method, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS auth_level, CAST(2 AS BIGINT) AS n
FROM supplier UNION ALL SELECT 'n' || s_nationkey, '{ADMIN_AJAX}pub' || s_suppkey, 'POST', 0, 1 FROM supplier"""
)
def ajax_literal(spark, sf_dir):
    """AJAX literals, their public twins, and the correlation of both."""
    hook = F.when(_key() % 2 == 0, "wp_ajax_nopriv_act").otherwise("wp_ajax_act")
    facts = _supplier(spark, sf_dir, "add_action('wp_ajax_act", _key(), "', 'f');\nadd_action('", hook, _key(), "', 'g');\nadd_action('wp_ajax_nopriv_pub", _key(), "', 'f');")
    return detect.ajax(facts).groupBy("plugin_slug", "route", "method", "auth_level").agg(F.count("*").alias("n"))


@_query(
    """SELECT 'n' || s_nationkey AS plugin_slug, '/wp-json/ns' || s_nationkey || '/v1/s/' || s_suppkey AS route, unnest(string_split(CASE WHEN s_suppkey % 2 = 0 THEN 'GET,POST' ELSE 'POST,PUT,PATCH' END, ',')) AS method, CAST(0 AS INTEGER) AS auth_level, 'cb' || s_suppkey AS callback FROM supplier"""
)
def rest_literal_methods(spark, sf_dir):
    """Literal REST routes and the expansion of their methods."""
    methods = F.when(_key() % 2 == 0, "'get, post'").otherwise("WP_REST_Server::EDITABLE")
    facts = _supplier(spark, sf_dir, "register_rest_route('ns", F.col("s_nationkey"), "/v1', '/s/", _key(), "', array('methods' => ", methods, ", 'callback' => 'cb", _key(), "', 'permission_callback' => '__return_true'));")
    return detect.rest(facts).select(*SHORT, "callback")


@_query(
    """SELECT '/wp-json/a/v1/x' || s_suppkey AS route, CAST(CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 5 ELSE 4 END AS INTEGER) AS auth_level FROM supplier"""
)
def rest_permission_levels(spark, sf_dir):
    """Levels of missing, public, inline, named and chained permission callbacks."""
    perm = F.when(_key() % 5 == 0, "").when(_key() % 5 == 1, ", 'permission_callback' => '__return_true'").when(_key() % 5 == 2, ", 'permission_callback' => function () { return current_user_can('edit_posts'); }").when(_key() % 5 == 3, ", 'permission_callback' => 'own_check'").otherwise(", 'permission_callback' => [$this, 'first']")
    facts = _supplier(spark, sf_dir, "class A { function first() { return $this->second(); } function second() { return current_user_can('moderate_comments'); } function go() {\nregister_rest_route('a/v1', '/x", _key(), "', ['callback' => 'c'", perm, "]); } }\nfunction own_check() { return current_user_can('manage_options'); }")
    return detect.rest(facts).select("route", "auth_level")


@_query("""SELECT '/wp-json/b/v1/y' || s_suppkey AS route, unnest(['GET', 'DELETE']) AS method FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT '/wp-json/b/v1/y' || s_suppkey, 'DELETE' FROM supplier WHERE s_suppkey % 3 = 0""")
def rest_multi_definitions(spark, sf_dir):
    """Routes with several definitions; blocked ones go."""
    perm = F.when(_key() % 3 == 0, "'__return_false'").otherwise("'__return_true'")
    facts = _supplier(spark, sf_dir, "register_rest_route('b/v1', 'y", _key(), "', [['methods' => 'GET', 'callback' => 'a', 'permission_callback' => ", perm, "], ['methods' => 'DELETE', 'callback' => 'b', 'permission_callback' => '__return_true']]);")
    return detect.rest(facts).select("route", "method")


@_query("""SELECT '/wp-json/own' || n_nationkey || '/v2/z' || n_nationkey AS route, 'own' || n_nationkey || '/v2' AS namespace, CAST(3 AS INTEGER) AS line FROM nation""")
def rest_symbol_resolution(spark, sf_dir):
    """Namespaces from constants, properties, variables and concatenations."""
    key = F.col("n_nationkey")
    ref = F.when(key % 3 == 0, "self::NS").when(key % 3 == 1, "$this->space").otherwise("$ns")
    facts = _nation(spark, sf_dir, "class A { const NS = 'own", key, "/v2'; protected $space = 'own", key, "/v2'; function go() { $ns = 'own", key, "' . '/v2';\nregister_rest_route(", ref, ", '/z' . ", key, ", ['callback' => 'c', 'permission_callback' => '__return_true']); } }")
    return detect.rest(facts).select("route", "namespace", F.col("line").cast("int").alias("line"))


@_query(
    """WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'manage_options' WHEN 'BUILDING' THEN 'edit_published_posts' WHEN 'FURNITURE' THEN 'edit_posts' WHEN 'MACHINERY' THEN 'manage_network' ELSE 'edit_pages' END AS cap FROM customer)
SELECT c_custkey, cap, CAST(CASE cap WHEN 'manage_options' THEN 5 WHEN 'edit_published_posts' THEN 4 WHEN 'edit_posts' THEN 2 WHEN 'manage_network' THEN 6 END AS INTEGER) AS level_cfg, CAST(CASE cap WHEN 'manage_options' THEN 5 WHEN 'edit_published_posts' THEN 3 WHEN 'edit_posts' THEN 2 WHEN 'manage_network' THEN 6 END AS INTEGER) AS level_map, CAST(CASE cap WHEN 'manage_options' THEN 5 WHEN 'edit_published_posts' THEN 3 WHEN 'edit_posts' THEN 2 WHEN 'manage_network' THEN 6 ELSE 4 END AS INTEGER) AS level_ast FROM c"""
)
def cap_level_lookup(spark, sf_dir):
    """Capabilities joined with the three maps of levels."""
    seg = F.col("c_mktsegment")
    cap = F.when(seg == "AUTOMOBILE", "manage_options").when(seg == "BUILDING", "edit_published_posts").when(seg == "FURNITURE", "edit_posts").when(seg == "MACHINERY", "manage_network").otherwise("edit_pages")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", cap.alias("cap"))
    return rows.join(F.broadcast(capability_dim(spark)), "cap", "left").select("c_custkey", "cap", "level_cfg", "level_map", "level_ast")


@_query(
    """WITH c AS (SELECT p_partkey, lower(CASE p_partkey % 6 WHEN 0 THEN 'manage_' WHEN 1 THEN 'edit_others_' WHEN 2 THEN 'view_' WHEN 3 THEN 'run_backup_' WHEN 4 THEN 'moderate_' ELSE 'delete_' END || replace(p_type, ' ', '_')) AS cap FROM part)
SELECT p_partkey, cap, CAST(CASE WHEN starts_with(cap, 'manage_') OR starts_with(cap, 'delete_') OR contains(cap, 'backup') THEN 5 WHEN contains(cap, '_others_') OR starts_with(cap, 'moderate_') THEN 4 ELSE 1 END AS INTEGER) AS auth_level FROM c"""
)
def cap_heuristic(spark, sf_dir):
    """Levels of unknown capabilities by their names."""
    k = F.col("p_partkey") % 6
    lead = F.when(k == 0, "manage_").when(k == 1, "edit_others_").when(k == 2, "view_").when(k == 3, "run_backup_").when(k == 4, "moderate_").otherwise("delete_")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat(lead, F.replace("p_type", F.lit(" "), F.lit("_")))).alias("cap"))
    return rows.withColumn("auth_level", R.capability_level(F.col("cap")).cast("int"))


@_query(
    """SELECT 'wp-admin/admin.php?page=page-' || n_nationkey AS route, CAST(CASE n_nationkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 1 END AS INTEGER) AS auth_level, CASE WHEN n_nationkey % 2 = 0 THEN 'add_menu_page' ELSE 'add_submenu_page:top' END AS namespace FROM nation"""
)
def admin_pages(spark, sf_dir):
    """Menu pages: capability to level, unknown capabilities to admin."""
    k = F.col("n_nationkey")
    cap = F.when(k % 4 == 0, "manage_options").when(k % 4 == 1, "edit_pages_x").when(k % 4 == 2, "something_odd").otherwise("read")
    cap = F.when(k % 4 == 1, "edit_others_pages").otherwise(cap)
    call = F.when(k % 2 == 0, "add_menu_page('T', 'T', '").otherwise("add_submenu_page('top', 'T', 'T', '")
    facts = _nation(spark, sf_dir, call, cap, "', 'page-", k, "', 'draw');")
    return detect.admin_pages(facts).select("route", "auth_level", "namespace")


@_query("""SELECT '[tag' || n_nationkey || ']' AS route, '[GET:g' || n_nationkey || ', POST:p]' AS raw_code, CAST(0 AS INTEGER) AS auth_level FROM nation""")
def shortcodes(spark, sf_dir):
    """Shortcodes with the input fields of their callbacks; the first of a tag counts."""
    k = F.col("n_nationkey")
    facts = _nation(spark, sf_dir, "add_shortcode('tag", k, "', 'draw'); add_shortcode('tag", k, "', 'other');\nfunction draw() { return $_POST['p'] . $_GET['g", k, "']; }")
    return detect.shortcodes(facts).select("route", "raw_code", "auth_level")


@_query("""SELECT 'widget:w' || r_regionkey || ':' || part AS route, CAST(CASE part WHEN 'render' THEN 0 ELSE 5 END AS INTEGER) AS auth_level FROM region, (VALUES ('render'), ('admin')) t(part)""")
def widgets(spark, sf_dir):
    """Widget classes: render and admin rows."""
    k = F.col("r_regionkey")
    facts = _corpus(_table(spark, sf_dir, "region"), F.lit("p"), F.concat(F.lit("w"), k, F.lit(".php")), "class W extends WP_Widget { function __construct() { parent::__construct('w", k, "', 'n'); } function widget($a, $b) { echo 1; } function form($i) {} function update($n, $o) {} }")
    return detect.widgets(facts).select("route", "auth_level")


@_query("""SELECT 'block:acme/b' || s_suppkey || ':render' AS route, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS auth_level FROM supplier UNION ALL SELECT 'block:acme/b' || s_suppkey || ':editor', 2 FROM supplier""")
def blocks(spark, sf_dir):
    """Blocks: render rows by their callback's body, editor rows for contributors."""
    body = F.when(_key() % 2 == 0, "if (!is_user_logged_in()) return;").otherwise("")
    facts = _supplier(spark, sf_dir, "register_block_type('acme/b", _key(), "', array('render_callback' => 'draw'));\nfunction draw() { ", body, " }")
    return detect.blocks(facts).select("route", "auth_level")


@_query(
    """SELECT '/wp-json/wp/v2/base' || r_regionkey || suffix AS route, verb AS method, CAST(lv AS INTEGER) AS auth_level FROM region, (VALUES ('', 'GET', 0), ('/{id}', 'GET', 0), ('', 'POST', 2), ('/{id}', 'PUT,PATCH', 2), ('/{id}', 'DELETE', 2)) t(suffix, verb, lv)"""
)
def cpt_rest_cross(spark, sf_dir):
    """Post types in REST, times their fixed operations."""
    k = F.col("r_regionkey")
    facts = _corpus(_table(spark, sf_dir, "region"), F.lit("p"), F.concat(F.lit("c"), k, F.lit(".php")), "register_post_type('t", k, "', ['show_in_rest' => true, 'rest_base' => 'base", k, "']); register_post_type('hidden', ['show_in_rest' => false]);")
    return detect.content_types(facts).select("route", "method", "auth_level")


@_query(f"""SELECT 'r' || n_regionkey AS plugin_slug, '{ADMIN_AJAX}w' || n_nationkey AS route, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS auth_level FROM nation""")
def wrapper_calls(spark, sf_dir):
    """Functions that register what they are given, joined with their calls."""
    k = F.col("n_nationkey")
    lead = F.when(k % 2 == 0, "nopriv_").otherwise("")
    facts = _nation(spark, sf_dir, "function reg", k, "($x, $name, $cb) { add_action('wp_ajax_' . $name, $cb); }\nreg", k, "(1, '", lead, "w", k, "', 'f');")
    return detect.wrapper_calls(facts).select("plugin_slug", "route", "auth_level")


@_query("""SELECT 'R' || n_nationkey AS method_name, CAST(1 AS INTEGER) AS param_index, '' AS prefix, 'hook' AS kind, n_nationkey % 2 = 0 AS is_static FROM nation""")
def wrapper_discovery(spark, sf_dir):
    """Methods whose parameter becomes a hook's name."""
    k = F.col("n_nationkey")
    static = F.when(k % 2 == 0, "static ").otherwise("")
    facts = _nation(spark, sf_dir, "class Q { public ", static, "function R", k, "($a, $hook) { add_filter($hook, $a); } function fixed($a) { add_action('init', $a); } }")
    return detect.wrappers(facts).select("method_name", "param_index", "prefix", "kind", "is_static")


@_query(f"""SELECT '{ADMIN_AJAX}item_' || n_nationkey AS route, CAST(1 AS INTEGER) AS auth_level FROM nation UNION ALL SELECT '{ADMIN_AJAX}var_' || n_nationkey, 1 FROM nation""")
def foreach_expand(spark, sf_dir):
    """Hooks in a foreach over inline and variable arrays: one row a literal."""
    names = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), "n_nationkey", F.lit("'")))), ", ").alias("keys"))
    facts = _corpus(names, F.concat(F.lit("r"), "n_regionkey"), F.lit("f.php"), "foreach ([", F.col("keys"), "] as $k) { add_action('wp_ajax_item_' . $k, 'f'); }\n$all = array(", F.col("keys"), "); foreach ($all as $i => $v) { add_action(\"wp_ajax_var_{$v}\", 'f'); }")
    return detect.ajax(facts).select("route", "auth_level")


@_query(
    f"""SELECT CASE s_suppkey % 4 WHEN 0 THEN 'wp-admin/admin-post.php?action=p' WHEN 1 THEN 'wp-admin/admin-post.php?action=q' WHEN 2 THEN '{ADMIN_AJAX}r' ELSE '?wc-ajax=t' END || s_suppkey AS route, CAST(CASE s_suppkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 1 END AS INTEGER) AS auth_level FROM supplier"""
)
def ajax_hook_kinds(spark, sf_dir):
    """Hook prefixes other than wp_ajax_, with their own levels."""
    hook = F.when(_key() % 4 == 0, "admin_post_p").when(_key() % 4 == 1, "admin_post_nopriv_q").when(_key() % 4 == 2, "admin_action_r").otherwise("wc_ajax_t")
    body = F.when(_key() % 4 == 2, "if (!is_user_logged_in()) die;").otherwise("")
    facts = _supplier(spark, sf_dir, "add_action('", hook, _key(), "', 'f'); function f() { ", body, " }")
    return detect.ajax(facts).select("route", "auth_level")


@_query(f"""SELECT '{ADMIN_AJAX}d' || n_nationkey AS route, 'inline' AS callback, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 0 END AS INTEGER) AS auth_level FROM nation""")
def ajax_direct(spark, sf_dir):
    """Comparisons of the request's action in code, either way round."""
    k = F.col("n_nationkey")
    test = F.when(k % 2 == 0, F.concat(F.lit("if (current_user_can('manage_options') && $_POST['action'] == 'd"), k.cast("string"), F.lit("') {}"))).otherwise(F.concat(F.lit("if ('d"), k.cast("string"), F.lit("' === $_REQUEST['action']) {}")))
    return detect.ajax(_nation(spark, sf_dir, test)).select("route", "callback", "auth_level")


@_query("""SELECT 'wp_ajax_nopriv_job' || n_nationkey AS route, CAST(0 AS INTEGER) AS auth_level FROM nation""")
def ajax_background(spark, sf_dir):
    """Subclasses, direct and indirect, of background processes with an action."""
    k = F.col("n_nationkey")
    facts = _nation(spark, sf_dir, "class Mid", k, " extends WP_Background_Process {} class Job", k, " extends Mid", k, " { protected $action = 'job", k, "'; }")
    return detect.background_jobs(facts).select("route", "auth_level")


@_query("""SELECT 'init:f' || n_nationkey AS route, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 0 END AS INTEGER) AS auth_level FROM nation WHERE n_nationkey % 3 <> 0""")
def hook_input(spark, sf_dir):
    """Early hooks whose callbacks read the request."""
    k = F.col("n_nationkey")
    body = F.concat(F.when(k % 2 == 0, "if (!is_super_admin()) return; ").otherwise(""), F.when(k % 3 == 0, "return 1;").otherwise("$x = $_GET['a'];"))
    facts = _nation(spark, sf_dir, "add_action('init', 'f", k, "'); add_action('save_post', 'f", k, "'); function f", k, "() { ", body, " }")
    return detect.hook_input(facts).select("route", "auth_level")


@_query("""SELECT 'r' || n_regionkey AS plugin_slug, 'init:far' || n_nationkey AS route FROM nation""")
def hook_input_far(spark, sf_dir):
    """Callbacks in other files that read the request through calls."""
    df = _table(spark, sf_dir, "nation").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("n_nationkey").cast("string")
    code = F.when(F.col("half") == 0, F.concat(F.lit("add_action('init', 'far"), k, F.lit("');"))).otherwise(F.concat(F.lit("function far"), k, F.lit("() { deep"), k, F.lit("(); } function deep"), k, F.lit("() { return $_POST['x']; }")))
    facts = _corpus(df, F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("f"), "n_nationkey", F.lit("_"), "half", F.lit(".php")), code)
    return detect.hook_input(facts).select("plugin_slug", "route")


@_query("""SELECT 's' || s_suppkey || '.php' AS route FROM supplier WHERE s_suppkey % 3 = 0""")
def direct_files(spark, sf_dir):
    """Files that read the request at once, without a guard."""
    code = F.when(_key() % 3 == 0, "echo $_GET['x'];").when(_key() % 3 == 1, "if (!defined('ABSPATH')) exit; echo $_GET['x'];").otherwise("echo 1;")
    return detect.direct_files(_supplier(spark, sf_dir, code)).select("route")


@_query(
    """SELECT CASE n_nationkey % 4 WHEN 0 THEN '/l' WHEN 1 THEN '/s' WHEN 2 THEN '/f' ELSE '/g' END || n_nationkey AS route, CASE n_nationkey % 4 WHEN 0 THEN 'GET,POST' WHEN 1 THEN 'PUT' WHEN 2 THEN 'DELETE' ELSE 'POST' END AS method, CASE n_nationkey % 4 WHEN 0 THEN 'laravel' WHEN 1 THEN 'slim-framework' WHEN 2 THEN 'fastroute' ELSE 'router' END AS namespace, CAST(1 AS INTEGER) AS auth_level FROM nation"""
)
def framework_routes(spark, sf_dir):
    """Routes of four routing styles."""
    k = F.col("n_nationkey")
    c = lambda a, b: F.concat(F.lit(a), k.cast("string"), F.lit(b))
    code = F.when(k % 4 == 0, c("Route::any('/l", "', 'h');")).when(k % 4 == 1, c("$app->put('/s", "', 'h');")).when(k % 4 == 2, c("$r->addRoute('delete', '/f", "', 'h');")).otherwise(c("$router->post('/g", "', 'h');"))
    return detect.framework(_nation(spark, sf_dir, code)).select("route", "method", "namespace", "auth_level")


@_query("""SELECT '/shop' || n_nationkey || '/{param1}/x/{param2}' AS route, CASE WHEN n_nationkey % 2 = 0 THEN 'page:p' || n_nationkey ELSE 'query:own' END AS callback FROM nation""")
def rewrite_rules(spark, sf_dir):
    """Rewrite rules as paths with numbered parameters."""
    k = F.col("n_nationkey")
    query = F.when(k % 2 == 0, F.concat(F.lit("index.php?pagename=p"), k.cast("string"), F.lit("&a=$matches[1]"))).otherwise("index.php?own=$matches[1]")
    facts = _nation(spark, sf_dir, "add_rewrite_rule('^shop", k, "/([^/]+)/x/([0-9]+)/?$', '", query, "', 'top');")
    return detect.framework(facts).select("route", "callback")


@_query("""SELECT '/xmlrpc.php:' || m || n_nationkey AS route FROM nation, (VALUES ('own.a'), ('own.b')) t(m)""")
def xmlrpc_methods(spark, sf_dir):
    """Methods that an XML-RPC filter adds."""
    k = F.col("n_nationkey")
    facts = _nation(spark, sf_dir, "add_filter('xmlrpc_methods', 'more'); function more($m) { $m['own.a", k, "'] = 'f'; $m['own.b", k, "'] = 'g'; return $m; }")
    return detect.framework(facts).select("route")


@_query("""SELECT 's' || s_suppkey || '.php' AS file, CAST(2 AS INTEGER) AS line, CASE WHEN s_suppkey % 3 = 0 THEN 'dynamic_args' ELSE 'complex_expression' END AS reason FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def coverage_gaps(spark, sf_dir):
    """Registrations without an endpoint within three lines, with the reason."""
    code = F.when(_key() % 3 == 0, "register_rest_route($a, $b, $c);").otherwise("register_rest_route(make(), 'x', []);")
    facts = _supplier(spark, sf_dir, code)
    found = detect.rest(facts).where(F.regexp_extract("file", r"(\d+)", 1).cast("int") % 2 == 1)
    return report.coverage_gaps(found, facts.calls).select("file", "line", "reason")


@_query(
    """WITH lv AS (SELECT user_id AS u, event_type AS t, event_id, CAST(event_id % 7 AS INTEGER) AS auth_level, lpad(CAST(event_id AS VARCHAR), 12, '0') AS file FROM events),
f AS (SELECT u, t, arg_min(auth_level, file) AS first_level, max(auth_level) AS top FROM lv GROUP BY u, t)
SELECT CAST(u AS VARCHAR) AS route, t AS method, CAST(CASE WHEN first_level = 0 THEN 0 ELSE top END AS INTEGER) AS auth_level FROM f"""
)
def dedup_fold(spark, sf_dir):
    """The ordered fold: higher levels replace the survivor unless it is public."""
    e = _table(spark, sf_dir, "events")
    rows = e.select(F.lit("p").alias("plugin_slug"), F.lit("ajax").alias("type"), F.col("user_id").cast("string").alias("route"), F.col("event_type").alias("method"), (F.col("event_id") % 7).cast("int").alias("auth_level"), F.lit("f").alias("callback"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"), F.lit(1).alias("line"), F.lit("").alias("raw_code"))
    return report.dedup(rows).select("route", "method", "auth_level")


def _orders(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("plugin_slug"), F.element_at(F.array(*map(F.lit, W.TYPES)), (F.col("o_orderkey") % 8).cast("int") + 1).alias("type"), level.alias("auth_level"), "o_orderkey")


_ORDERS_SQL = "(SELECT 'p' || (o_custkey % 50) AS plugin_slug, ['rest', 'ajax', 'admin', 'shortcode', 'widget', 'block', 'hook_input', 'direct'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS type, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS auth_level, o_orderkey FROM orders)"


@_query(
    "SELECT count(*) AS total_endpoints, "
    + ", ".join(f"count(*) FILTER (auth_level = {k}) AS {n}_count" for k, n in enumerate(W.LEVELS))
    + ", "
    + ", ".join(f"count(*) FILTER (type = '{t}') AS {'admin_pages' if t == 'admin' else t}_count" for t in W.TYPES)
    + f", count(*) FILTER (auth_level >= 1) AS authenticated_count, count(DISTINCT plugin_slug) AS total_plugins FROM {_ORDERS_SQL}"
)
def endpoint_summary(spark, sf_dir):
    """All counters in one pass."""
    return report.summary(_orders(spark, sf_dir))


@_query(f"SELECT o_orderkey, auth_level FROM {_ORDERS_SQL} WHERE auth_level IN (1, 5)")
def filter_auth(spark, sf_dir):
    """Union of level filters; user stands for subscriber."""
    return report.filter_levels(_orders(spark, sf_dir), ["user", "admin"]).select("o_orderkey", "auth_level")


@_query(f"SELECT o_orderkey FROM {_ORDERS_SQL} WHERE type = 'rest' AND plugin_slug = 'p7'")
def filter_type(spark, sf_dir):
    """Accessors of an analysis: by type, then by plugin."""
    from .plans.analyze import Analysis

    of = lambda rows: Analysis(rows, None, None)
    return of(of(_orders(spark, sf_dir)).by_type("rest")).by_plugin("p7").select("o_orderkey")


@_query(f"SELECT auth_level, {LEVEL_SQL.format(x='auth_level')} AS name, count(*) AS n FROM {_ORDERS_SQL} GROUP BY auth_level")
def by_level(spark, sf_dir):
    return report.by_level(_orders(spark, sf_dir))


@_query(
    """WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'N'), d AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'N')
SELECT file, line, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file = c.file AND d.line BETWEEN c.line - 3 AND c.line + 3) GROUP BY file, line"""
)
def band_anti_join(spark, sf_dir):
    """Calls without an endpoint within three lines, at the scale of lineitem."""
    rows = _table(spark, sf_dir, "lineitem").select(F.lit("p").alias("plugin_slug"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), "l_returnflag")
    calls = rows.where("l_returnflag = 'N'").select("plugin_slug", "file", "line", F.lit("register_rest_route").alias("callee"), F.lit("").alias("raw"), F.lit("").alias("before"))
    ends = rows.where("l_returnflag <> 'N'").withColumn("type", F.lit("rest"))
    return report.coverage_gaps(ends, calls).groupBy("file", "line").agg(F.count("*").alias("n"))


@_query(
    """WITH pre(hook, cb) AS (VALUES ('P', 'a'), ('Brand#1', 'b'), ('Brand', 'c'), ('Brand#2x', 'd')), f AS (SELECT DISTINCT p_brand AS fired FROM part)
SELECT fired, cb AS callback FROM f JOIN pre ON starts_with(fired, hook) UNION SELECT fired, 'e' FROM f WHERE fired = 'Brand#13'"""
)
def hook_prefix_join(spark, sf_dir):
    """Fired hooks with registered callbacks: exact names and prefixes."""
    reg = spark.createDataFrame([("p", "P", True, "a", "f"), ("p", "Brand#1", True, "b", "f"), ("p", "Brand", True, "c", "f"), ("p", "Brand#2x", True, "d", "f"), ("p", "Brand#13", False, "e", "f")], "plugin_slug string, hook string, is_prefix boolean, callback string, file string")
    names = _table(spark, sf_dir, "part").select(F.lit("p").alias("plugin_slug"), F.col("p_brand").alias("fired")).distinct()
    return graph.fired(names, reg).select("fired", "callback")


@_query(
    """WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linestatus AS route, CAST(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 4 END AS INTEGER) AS lv, l_linenumber AS line FROM lineitem)
SELECT file, line, route, CAST(CASE WHEN lv = 1 AND bool_or(lv = 0) OVER (PARTITION BY file, route) THEN 0 ELSE lv END AS INTEGER) AS auth_level FROM e"""
)
def nopriv_semi(spark, sf_dir):
    """Subscriber rows become public where their route is public in the same file."""
    rows = _table(spark, sf_dir, "lineitem").select(F.lit("p").alias("plugin_slug"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linestatus").alias("route"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(4).alias("auth_level"), F.col("l_linenumber").alias("line"), F.lit("").alias("raw_code"))
    return detect.correlate(rows).select("file", "line", "route", "auth_level")


_EDGE_SQL = "e AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS src, CAST(c_custkey // 3 AS VARCHAR) AS dst FROM customer WHERE c_custkey >= 3)"


def _edges(spark, sf_dir):
    return _table(spark, sf_dir, "customer").where("c_custkey >= 3").select(F.lit("p").alias("plugin_slug"), F.col("c_custkey").cast("string").alias("src"), F.floor(F.col("c_custkey") / 3).cast("string").alias("dst"))


@_query(f"""WITH RECURSIVE {_EDGE_SQL}, r(root, node) AS (SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0 UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) SELECT root, node FROM r""")
def call_closure(spark, sf_dir):
    """All that roots reach over call edges."""
    roots = _table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.lit("p").alias("plugin_slug"), F.col("c_custkey").cast("string").alias("root"))
    return graph.closure(_edges(spark, sf_dir), roots).select("root", "node")


def _classes(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select(F.lit("p").alias("plugin_slug"), F.concat(F.lit("N\\C"), "c_custkey").alias("fqn"), F.when(F.col("c_custkey") >= 3, F.concat(F.lit("N\\C"), F.floor(F.col("c_custkey") / 3))).otherwise("").alias("parent"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("T"), "c_custkey"))).otherwise(F.array().cast("array<string>")).alias("traits"))


@_query(f"""WITH RECURSIVE {_EDGE_SQL}, r(node) AS (SELECT src FROM e WHERE dst = '1' UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT 'N\\C' || node AS fqn FROM r""")
def subclasses(spark, sf_dir):
    """All descendants of a class."""
    return graph.subclasses(_classes(spark, sf_dir), ["C1"]).select("fqn")


@_query(
    f"""WITH RECURSIVE {_EDGE_SQL}, r(root, node, d) AS (SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR), 0 FROM customer UNION ALL SELECT r.root, e.dst, d + 1 FROM r JOIN e ON r.node = e.src),
a AS (SELECT root, 'N\\C' || node AS node, d, 0 AS k FROM r UNION ALL SELECT root, 'T' || node, d, 1 FROM r WHERE CAST(node AS BIGINT) % 2 = 0 AND CAST(node AS BIGINT) IN (SELECT c_custkey FROM customer))
SELECT 'N\\C' || root AS fqn, CAST(row_number() OVER (PARTITION BY root ORDER BY d, k) - 1 AS INTEGER) AS pos, node FROM a"""
)
def mro(spark, sf_dir):
    """Method resolution order: class, traits, parents."""
    return graph.method_order(_classes(spark, sf_dir)).select("fqn", F.col("pos").cast("int").alias("pos"), "node")


@_query("""WITH RECURSIVE r(root, node) AS (SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT r.root, s.s_suppkey FROM r JOIN supplier s ON s.s_suppkey = r.node + 1 AND s.s_suppkey % 7 <> 0) SELECT 's' || root || '.php' AS root, 's' || node || '.php' AS file FROM r""")
def reachable_includes(spark, sf_dir):
    """Files that includes reach, transitively."""
    code = F.when((_key() + 1) % 7 == 0, "").otherwise(F.concat(F.lit("require_once __DIR__ . '/s"), (_key() + 1).cast("string"), F.lit(".php';")))
    s = _table(spark, sf_dir, "supplier")
    facts = _corpus(s, F.lit("p"), F.concat(F.lit("s"), "s_suppkey", F.lit(".php")), code)
    roots = s.where("s_suppkey % 10 = 0").select(F.lit("p").alias("plugin_slug"), F.concat(F.lit("s"), "s_suppkey", F.lit(".php")).alias("root"))
    return graph.closure(graph.include_edges(facts.files, facts.includes), roots).select("root", F.col("node").alias("file"))


@_query(
    """SELECT 'n' || s_nationkey AS plugin_slug, p || s_suppkey || '.php' AS file FROM supplier, (VALUES ('root', 0), ('inc/deep', 0), ('inc/more', 1), ('lib/class-k', 2), ('templates/t', 3)) v(p, c) WHERE c = 0 OR s_suppkey % 4 = c"""
)
def reachable_files(spark, sf_dir):
    """Root files, then what they include, what that includes, classes they name, and templates; nested files that nothing names stay out."""
    s = _table(spark, sf_dir, "supplier")
    k, kind = _key().cast("string"), _key() % 4
    root = F.concat(F.lit("<?php add_action('wp_ajax_f', 'f"), k, F.lit("'); function f"), k, F.lit("() {} require __DIR__ . '/inc/deep"), k, F.lit(".php';"), F.when(kind == 2, F.concat(F.lit(" new Lib_K"), k, F.lit("();"))).otherwise(""))
    deep = F.concat(F.lit("<?php "), F.when(kind == 1, F.concat(F.lit("include 'more"), k, F.lit(".php';"))).otherwise(""))
    made = [("root", root), ("inc/deep", deep), ("inc/more", F.lit("<?php echo 1;")), ("lib/class-k", F.concat(F.lit("<?php class Lib_K"), k, F.lit(" {}"))), ("other/unnamed", F.lit("<?php echo 2;"))]
    rows = [F.struct(F.concat(F.lit(p), k, F.lit(".php")).alias("file"), c.cast("binary").alias("content")) for p, c in made]
    page = F.struct(F.concat(F.lit("templates/t"), k, F.lit(".php")).alias("file"), F.lit("<?php echo 3;").cast("binary").alias("content"))
    files = s.withColumn("r", F.explode(F.concat(F.array(*rows), F.when(kind == 3, F.array(page)).otherwise(F.array())))).select(F.concat(F.lit("n"), "s_nationkey").alias("plugin_slug"), "r.*")
    facts = build(files)
    return graph.reachable_files(facts, detect.ajax(facts).unionByName(detect.hook_input(facts)).unionByName(detect.direct_files(facts))).select("plugin_slug", "file")


@_query("""SELECT 'a' || n_nationkey AS name, ['b' || n_nationkey, 'c' || n_nationkey] AS function_calls FROM nation""")
def callees(spark, sf_dir):
    """Sorted callees over all definitions of a name; core functions and keywords do not count."""
    k = F.col("n_nationkey")
    facts = _nation(spark, sf_dir, "function a", k, "() { c", k, "(); if (strlen('x')) { b", k, "(); c", k, "(); } } function b", k, "() {} function c", k, "() {}")
    return graph.callees(facts.functions).select("name", "function_calls")


@_query("""SELECT 'chk' || n_nationkey AS name, CAST(4 AS INTEGER) AS chain_level FROM nation UNION ALL SELECT 'mid' || n_nationkey, 4 FROM nation""")
def capability_chain(spark, sf_dir):
    """The first capability in depth-first order of calls."""
    k = F.col("n_nationkey")
    facts = _nation(spark, sf_dir, "function chk", k, "() { return mid", k, "(); } function mid", k, "() { return last", k, "(); } function last", k, "() { return current_user_can('edit_others_posts'); }")
    return graph.capability_chain(facts.functions).select("name", "chain_level")


@_query("""SELECT page_id, CAST(unnest(generate_series(1, len(h))) - 1 AS INTEGER) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"'']*)["'']', 1) AS h FROM pages)""")
def page_links(spark, sf_dir):
    """Anchors of pages in order."""
    return corpus.links(_table(spark, sf_dir, "pages"), "page_id", "html")


@_query("""SELECT page_id, CAST(greatest(1, coalesce(list_max(list_transform(regexp_extract_all('<a href="/x/page/' || (page_id % 40) || '">' || html, '/page/([0-9]+)', 1), lambda x: CAST(x AS INTEGER))), 1)) AS INTEGER) AS pages FROM pages""")
def page_max(spark, sf_dir):
    """The largest page number of pagination links."""
    p = _table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit('<a href="/x/page/'), F.col("page_id") % 40, F.lit('">'), "html"))
    return corpus.page_count(p, "page_id", "html")


@_query("""SELECT page_id, slug, CAST(min(pos) AS INTEGER) AS pos FROM (SELECT page_id, unnest([p1, 'browse', p2, p1]) AS slug, unnest([0, 1, 2, 3]) AS pos FROM (SELECT page_id, 'a' || (page_id % 9) AS p1, 'b' || page_id AS p2 FROM pages)) WHERE slug <> 'browse' GROUP BY page_id, slug""")
def plugin_slugs(spark, sf_dir):
    """Slugs of plugin links, distinct in order, without reserved names."""
    link = lambda c: F.concat(F.lit('<a class="x" href="https://h/plugins/'), c, F.lit('/">'))
    a, b = F.concat(F.lit("a"), F.col("page_id") % 9), F.concat(F.lit("b"), "page_id")
    p = _table(spark, sf_dir, "pages").select("page_id", F.concat(link(a), link(F.lit("browse")), link(b), link(a)).alias("html"))
    return corpus.plugin_slugs(p, "page_id", "html").select("page_id", "slug", F.col("pos").cast("int").alias("pos"))


@_query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS text, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_tags FROM events""")
def flex_json(spark, sf_dir):
    """Lenient strings and maps of API responses."""
    e = F.col("event_id")
    text = F.when(e % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(e % 3 == 0, "false").otherwise("null")
    tags = F.when(e % 3 == 0, "[]").otherwise('{"a":"b"}')
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"text":'), text, F.lit(',"tags":'), tags, F.lit("}")).alias("json"))
    return rows.select("event_id", corpus.flex_string("json", "text").alias("text"), F.size(corpus.flex_map("json", "tags")).alias("n_tags"))


_BUCKET_SQL = "CASE " + " ".join(f"WHEN n >= {k} THEN '{v}'" for k, v in W.INSTALL_BUCKETS) + " ELSE 'Less than 10' END"


@_query(f"SELECT o_orderkey, {_BUCKET_SQL} AS bucket FROM (SELECT o_orderkey, o_custkey * o_custkey * (o_orderkey % 100) AS n FROM orders)")
def installs_bucket(spark, sf_dir):
    n = F.col("o_custkey") * F.col("o_custkey") * (F.col("o_orderkey") % 100)
    return _table(spark, sf_dir, "orders").select("o_orderkey", R.install_bucket(n).alias("bucket"))


@_query("""SELECT doc_id, coalesce(length(text), 0) + 13 AS n, coalesce(length(text) - length(replace(text, chr(10), '')), 0) + 1 AS lines, true AS blank FROM documents""")
def strip_comments_len(spark, sf_dir):
    """Comments are blanked; length and line breaks stay."""
    from .php.lexer import strip_comments

    strip = F.udf(strip_comments, "string", useArrow=False)  # a hundred texts at a time, not a batch of ten thousand
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* "))  # a comment's end cannot stand inside it
    d = _table(spark, sf_dir, "documents").withColumn("s", strip(F.concat(F.lit("<?php /*"), text, F.lit("*/\n1;"))))
    breaks = F.length("s") - F.length(F.replace("s", F.lit("\n"), F.lit("")))
    return d.select("doc_id", F.length("s").cast("long").alias("n"), breaks.cast("long").alias("lines"), (F.trim(F.regexp_replace("s", r"\s+", " ")) == "<?php 1;").alias("blank"))


@_query("""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line FROM documents""")
def line_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", R.line_of(F.col("text"), F.length("text")).alias("line"))


@_query(
    """WITH r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '/user/x' WHEN 1 THEN '/settings/y' WHEN 2 THEN '/public/z' WHEN 3 THEN '/delete/q' ELSE '/plain' END AS route, CAST(s_suppkey % 3 AS INTEGER) AS lv FROM supplier)
SELECT s_suppkey, CAST(CASE WHEN route = '/user/x' THEN greatest(lv, 1) WHEN route = '/settings/y' THEN CASE WHEN lv < 2 THEN 5 ELSE lv END WHEN route = '/public/z' THEN 0 WHEN route = '/delete/q' AND lv = 1 THEN 5 ELSE lv END AS INTEGER) AS auth_level FROM r"""
)
def route_heuristics(spark, sf_dir):
    """Route words that raise or lower a declared level."""
    route = F.when(_key() % 5 == 0, "/user/x").when(_key() % 5 == 1, "/settings/y").when(_key() % 5 == 2, "/public/z").when(_key() % 5 == 3, "/delete/q").otherwise("/plain")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", R.route_level(route, F.lit("a/v1"), (_key() % 3).cast("int"), F.lit(False)).cast("int").alias("auth_level"))


@_query(
    r"""WITH p AS (SELECT p_brand AS plugin_slug, (p_partkey % 7 + 7) % 7 AS k, p_partkey AS id, p_size AS size, split_part(p_name, ' ', -1) AS noun FROM part),
r AS (SELECT DISTINCT plugin_slug, true AS manual, '/wp-json/a/v1/' || CASE k WHEN 0 THEN 'items' || id WHEN 1 THEN 'items' || id || '/{id}' WHEN 2 THEN 'catalogue' || id WHEN 3 THEN 'orders' || size || '/void/m' || id || '/all' WHEN 4 THEN 'orders' || id || '/list' WHEN 5 THEN 'zzz' || id || '/y9' ELSE noun || '/x' || id || '/all' END AS route FROM p
UNION ALL SELECT DISTINCT plugin_slug, false, '/wp-json/' || CASE k WHEN 0 THEN 'a/v1/items' || id WHEN 1 THEN 'a/v1/items' || id || '/{key}' WHEN 2 THEN 'b/v2/catalogue' || id WHEN 3 THEN 'a/v1/orders' || size || '/void/d' || id || '/one' WHEN 4 THEN 'a/v1/orders' || id || '/list/all' WHEN 5 THEN 'b/q' ELSE 'c/' || noun || '/w' || id END FROM p),
n AS (SELECT *, regexp_replace(route[10:], '\{[^}]+\}', '*', 'g') AS norm FROM r),
c AS (SELECT *, coalesce(list_filter(string_split(norm, '/'), lambda x: length(x) > 1), []) AS parts FROM n),
e AS (SELECT *, array_to_string(parts, '/') AS key, coalesce(parts[-1], '') AS last, list_filter(parts, lambda x: length(x) > 2) AS long FROM c),
s AS (SELECT m.plugin_slug, m.route, d.route AS found, CASE WHEN m.norm = d.norm THEN 2.0 WHEN m.key = d.key AND m.key <> '' THEN 1.0 WHEN (contains(m.key, d.key) OR contains(d.key, m.key)) AND length(m.key) > 3 AND length(d.key) > 3 THEN 0.8 WHEN m.last = d.last AND length(m.last) > 3 THEN 0.7 WHEN (contains(m.last, d.last) OR contains(d.last, m.last)) AND greatest(length(m.last), length(d.last)) > 5 THEN 0.6 WHEN len(list_intersect(m.long, d.long)) >= 2 THEN 0.6 WHEN list_has_any(m.long, d.long) AND least(greatest(len(m.parts), 1), greatest(len(d.parts), 1)) <= 2 THEN 0.5 END AS score FROM e m JOIN e d ON m.plugin_slug = d.plugin_slug AND m.manual AND NOT d.manual),
b AS (SELECT plugin_slug, route, max(struct_pack(score := score, found := found)) AS best FROM s WHERE score IS NOT NULL GROUP BY ALL)
SELECT r.plugin_slug, r.route, b.best.found AS matched, CAST(CASE WHEN b.best.score > 1 THEN 1 ELSE b.best.score END AS DOUBLE) AS score FROM r LEFT JOIN b ON r.plugin_slug = b.plugin_slug AND r.route = b.route WHERE r.manual"""
)
def fuzzy_match(spark, sf_dir):
    """Manual routes with their best detected route among all of their plugin, a brand: equal, contained, of the same last part, of shared parts, none."""
    noun = F.substring_index("p_name", " ", -1)
    pick = lambda *routes: F.element_at(F.array(*(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in r)) for r in routes)), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    p = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("plugin_slug"), F.lit("rest").alias("type"), key, size, "p_name")
    manual = pick(["items", key], ["items", key, "/{id}"], ["catalogue", key], ["orders", size, "/void/m", key, "/all"], ["orders", key, "/list"], ["zzz", key, "/y9"], [noun, "/x", key, "/all"])
    detected = pick(["a/v1/items", key], ["a/v1/items", key, "/{key}"], ["b/v2/catalogue", key], ["a/v1/orders", size, "/void/d", key, "/one"], ["a/v1/orders", key, "/list/all"], ["b/q"], ["c/", noun, "/w", key])
    rows = lambda lead, route: p.select("plugin_slug", "type", F.concat(F.lit(lead), route).alias("route"))
    return report.match_manual(rows("/wp-json/a/v1/", manual), rows("/wp-json/", detected)).select("plugin_slug", "route", "matched", "score")


@_query(
    """WITH l AS (SELECT s_nationkey AS f, s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'admin' WHEN 3 THEN 'subscriber' END AS h FROM supplier), c AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY f ORDER BY k ROWS UNBOUNDED PRECEDING) AS level FROM l)
SELECT 'f' || f AS file, CAST(k AS BIGINT) AS line_no, level, CASE k % 5 WHEN 1 THEN '/wp-json/a/' WHEN 2 THEN 'wp_ajax_b' ELSE 'admin.php?page=' END || k AS route, CASE k % 5 WHEN 1 THEN 'rest' WHEN 2 THEN 'ajax' ELSE 'admin' END AS type FROM c WHERE h IS NULL AND level IS NOT NULL"""
)
def carry_forward(spark, sf_dir):
    """Manual truth: section headers hold for the lines after them."""
    k = _key() % 5
    text = F.when(k == 0, "== Admin endpoints ==").when(k == 3, "SUBSCRIBER:").otherwise(F.concat(F.when(k == 1, "  /wp-json/a/").when(k == 2, "wp_ajax_b").otherwise("admin.php?page="), _key()))
    lines = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_nationkey").alias("file"), _key().alias("line_no"), text.alias("value"))
    return corpus.manual_truth(lines)


@_query("""SELECT 'ajax' AS type, event_type || '/x' || user_id AS pattern, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, type, pattern LIMIT 20""")
def topn_missed(spark, sf_dir):
    """The 20 most frequent patterns without a match, a report's limit."""
    rows = _table(spark, sf_dir, "events").select(F.lit("ajax").alias("type"), F.concat(F.lit("/"), "event_type", F.lit("/x"), "user_id", F.lit("/y"), "event_id").alias("route"), F.lit(None).cast("string").alias("matched"))
    return report.missed_patterns(rows)


@_query("""SELECT 'F' || n_nationkey || '.php' AS file, '/wp-json/k' || n_nationkey || '/v1/r' AS route, ' [resolved-from-constant:NSX' || n_nationkey || ']' AS tag FROM nation""")
def resolve_constants(spark, sf_dir):
    """Placeholders of routes from constants of other files."""
    df = _table(spark, sf_dir, "nation").withColumn("half", F.explode(F.array(F.lit("F"), F.lit("G"))))
    k = F.col("n_nationkey").cast("string")
    code = F.when(F.col("half") == "F", F.concat(F.lit("register_rest_route(NSX"), k, F.lit(", '/r', ['callback' => 'c', 'permission_callback' => '__return_true']);"))).otherwise(F.concat(F.lit("define('NSX"), k, F.lit("', 'k"), k, F.lit("/v1');")))
    facts = _corpus(df, F.concat(F.lit("p"), "n_nationkey"), F.concat("half", "n_nationkey", F.lit(".php")), code)
    found = report.resolve_routes(detect.rest(facts), facts)
    return found.select("file", "route", F.regexp_extract("raw_code", r"( \[resolved.*\])$", 1).alias("tag"))


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN true ELSE false END AS hit FROM supplier""")
def path_match(spark, sf_dir):
    """Case-free equality or suffix of paths."""
    a = F.concat(F.lit("Dir/Sub/S"), _key(), F.lit(".php"))
    b = F.when(_key() % 2 == 0, F.concat(F.lit("sub\\s"), _key(), F.lit(".PHP"))).otherwise(F.concat(F.lit("ub/s"), _key(), F.lit(".php")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", report.path_match(a, b).alias("hit"))


@_query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25""")
def first_successes(spark, sf_dir):
    """The first successes in rank order, an operator's limit."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rank"), (F.col("o_orderstatus") == "F").alias("success"))
    return corpus.first_successes(rows, 25).select(F.col("rank").alias("o_orderkey"))


@_query("""SELECT 'n' || s_nationkey AS plugin_slug, 'Name ' || s_suppkey AS name, CAST(s_acctbal AS BIGINT) || '.0' AS version FROM supplier WHERE s_suppkey IN (SELECT min(s_suppkey) FROM supplier GROUP BY s_nationkey)""")
def plugin_headers(spark, sf_dir):
    """Names and versions of plugins' first root files."""
    s = _table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("<?php\n/*\n * Plugin Name: Name "), "s_suppkey", F.lit("\n * Version: "), F.round("s_acctbal").cast("long"), F.lit(".0\n */"))
    files = s.select(F.concat(F.lit("n"), "s_nationkey").alias("plugin_slug"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".php")).alias("file"), text.cast("binary").alias("content"))
    return corpus.plugin_headers(files)


@_query("""SELECT 'p' || s_nationkey AS plugin_slug, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 IN (0, 3)""")
def corpus_prune(spark, sf_dir):
    """PHP files that a scan keeps: by suffix, by directory, by composer.json above."""
    name = F.when(_key() % 4 == 0, "inc/a").when(_key() % 4 == 1, "vendor/a").when(_key() % 4 == 2, "lib/deep/a").otherwise("Vendor/a")
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_nationkey").alias("plugin_slug"), F.concat(name, "s_suppkey", F.lit(".PHP")).alias("file"), F.lit(b"<?php").alias("content"), _key().alias("k"))
    composer = s.select("plugin_slug").distinct().select("plugin_slug", F.lit("lib/composer.json").alias("file"), F.lit(b"{}").alias("content"), F.lit(None).cast("long").alias("k"))
    return corpus.php_files(s.unionByName(composer), Config()).select("plugin_slug", "k")


@_query()
def full_analysis(spark, sf_dir):
    """The whole analysis over a generated corpus: parse, detect, resolve, dedup."""
    from .plans.analyze import analyze

    code = F.concat(F.lit("<?php\n/*\n * Plugin Name: X\n */\nadd_action('wp_ajax_nopriv_a"), _key(), F.lit("', 'f'); function f() { return $_POST['x']; }\nregister_rest_route('x/v1', '/r"), _key(), F.lit("', ['callback' => 'f', 'permission_callback' => '__return_true']);\nadd_menu_page('T', 'T', 'manage_options', 'm"), _key(), F.lit("', 'f');"))
    files = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("plugin_slug"), F.concat(F.lit("s"), "s_suppkey", F.lit(".php")).alias("file"), code.cast("binary").alias("content"))
    return analyze(files).endpoints.select("plugin_slug", "type", "route", "method", "auth_level", "callback", "file", "line")


_SQL["full_analysis"] = f"""SELECT 'n' || s_nationkey AS plugin_slug, t AS type, r || s_suppkey AS route, m AS method, CAST(lv AS INTEGER) AS auth_level, 'f' AS callback, 's' || s_suppkey || '.php' AS file, CAST(ln AS INTEGER) AS line
FROM supplier, (VALUES ('ajax', '{ADMIN_AJAX}a', 'POST', 0, 5), ('rest', '/wp-json/x/v1/r', 'GET', 0, 6), ('admin', 'wp-admin/admin.php?page=m', 'GET', 5, 7)) v(t, r, m, lv, ln)
UNION ALL SELECT 'n' || s_nationkey, 'direct', 's' || s_suppkey || '.php', 'GET/POST', 0, '', 's' || s_suppkey || '.php', 1 FROM supplier"""


def queries() -> dict[str, Query]:
    return _QUERIES | cases.queries() | tools.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | cases.oracle_sql() | tools.oracle_sql()
