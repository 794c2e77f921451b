"""Registered queries made of cases: PHP snippets, one for each supplier in turn, with their expected rows.

In a snippet and in expected values ``@`` stands for the supplier's key, so the SQL side derives every
row from the same column. Each snippet begins on line 2 of a file named s@.php of plugin n<nation>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, dispatch, graph, report
from .plans.facts import Facts, build

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AJAX, POST, REST = "wp-admin/admin-ajax.php?action=", "wp-admin/admin-post.php?action=", "/wp-json/"
OPEN = "'permission_callback' => '__return_true'"


def corpus_of(spark: SparkSession, sf_dir: str, snippets: list[str]) -> Facts:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.element_at(F.array(*map(F.lit, snippets)), (F.col("s_suppkey") % len(snippets) + 1).cast("int"))
    code = F.concat(F.lit("<?php\n"), F.replace(code, F.lit("@"), F.col("s_suppkey").cast("string")))
    return build(s.select(F.concat(F.lit("n"), "s_nationkey").alias("plugin_slug"), F.concat(F.lit("s"), "s_suppkey", F.lit(".php")).alias("file"), code.cast("binary").alias("content")))


def _literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"CAST({value} AS INTEGER)"
    return "'" + value.replace("'", "''") + "'"


def expected_sql(columns: list[str], cases: list[tuple[str, list[tuple]]]) -> str:
    """Rows of each supplier's case, with its key for ``@``."""
    rows = [(k, *row) for k, (_, found) in enumerate(cases) for row in found]
    values = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in rows)
    texts = {n for k, n in enumerate(columns, 1) if isinstance(rows[0][k], str)}
    out = ", ".join(f"replace({c}, '@', CAST(s_suppkey AS VARCHAR)) AS {c}" if c in texts else c for c in columns)
    return f"SELECT {out} FROM supplier JOIN (VALUES {values}) v(k, {', '.join(columns)}) ON s_suppkey % {len(cases)} = k"


def by_case(columns: str, *cases: tuple[str, list[tuple]], sql: str = ""):
    """Register a query from facts to rows, with the expected rows of its cases, or their SQL."""
    names = columns.split()

    def add(f: Callable[[Facts], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(corpus_of(spark, sf_dir, [code for code, _ in cases])).select(*names)

        query.__doc__ = f.__doc__
        _QUERIES[f.__name__], _SQL[f.__name__] = query, sql or expected_sql(names, list(cases))
        return f

    return add


# REST shapes


@by_case(
    "route method auth_level",
    (f"class A {{ protected $namespace = 'w@/v1'; function go() {{ $this->register_route('/a@', ['methods' => 'POST', 'callback' => 'f', {OPEN}]); }} }}", [(REST + "w@/v1/a@", "POST", 0)]),
    (f"class A {{ const NAMESPACE = 'x@/v1'; static function go() {{ self::register_route('/b@', ['callback' => 'f', {OPEN}]); }} }}", [(REST + "x@/v1/b@", "GET", 0)]),
    (f"class A {{ const REST_ROOT = 'y@/v1'; function go() {{ new REST_Route('c@', ['methods' => 'DELETE', 'callback' => 'f', {OPEN}]); }} }}", [(REST + "y@/v1/c@", "DELETE", 0)]),
    (f"class A {{ protected $rest_namespace = 'z@/v2'; function go() {{ $this->_register_route('/d@', ['callback' => 'f', {OPEN}]); }} }}", [(REST + "z@/v2/d@", "GET", 5)]),
    (
        f"class A {{ protected $namespace = 'aa@/v1'; function go() {{ $this->register_route('/e@', ['callback' => 'f', {OPEN}]); }} }} class B {{ function get_namespace() {{ return 'bb@/v1'; }} protected $namespace = 'no@/v1'; function go() {{ $this->register_route('/e@', ['callback' => 'f', {OPEN}]); }} }} class C {{ const NS = 'cc@/v1'; static function go() {{ self::register_route('/e@', ['callback' => 'f', {OPEN}]); }} }} class D {{ function go() {{ $this->register_route('/e@', ['callback' => 'f', {OPEN}]); }} }}",
        [(REST + "aa@/v1/e@", "GET", 0), (REST + "bb@/v1/e@", "GET", 0), (REST + "cc@/v1/e@", "GET", 0), (REST + "bb@/v1/e@", "GET", 0)],
    ),
    ("class E { const REST_API_NAMESPACE = 'ee@/v1'; static function go() { self::register_route('/z@', 'cb', WP_REST_Server::EDITABLE); self::register_route('/y@', 'cb', WP_REST_Server::DELETABLE); self::register_route('/x@', 'cb'); } }", [(REST + "ee@/v1/z@", "POST", 5), (REST + "ee@/v1/z@", "PUT", 5), (REST + "ee@/v1/z@", "PATCH", 5), (REST + "ee@/v1/y@", "DELETE", 5), (REST + "ee@/v1/x@", "GET", 5)]),
    (f"class F {{ function get_slug() {{ return 'sl@'; }} function get_namespace() {{ return \"p/{{$this->get_slug()}}/v2\"; }} function go() {{ $this->register_route('/g@', ['callback' => 'f', {OPEN}]); }} }}", [(REST + "p/sl@/v2/g@", "GET", 0)]),
)
def rest_short_calls(facts):
    """Registrations whose namespace is the class's own."""
    return detect.rest(facts)


@by_case(
    "route namespace auth_level",
    (f"register_rest_route(untrailingslashit('u@/v1'), '/a', ['callback' => 'f', {OPEN}]);", [(REST + "u@/v1/a", "u@/v1", 0)]),
    (f"$args = ['callback' => 'f', {OPEN}];\nregister_rest_route('v@/v1', '/b', $args);", [(REST + "v@/v1/b", "v@/v1", 0)]),
    (f"register_rest_route('s@/v1', sprintf('/c/%s/%d', 'x', 7), ['callback' => 'f', {OPEN}]);", [(REST + "s@/v1/c/x/7", "s@/v1", 0)]),
    (f"register_rest_route(\"i@/v1\", \"/d/{{$id}}/x\", ['callback' => 'f', {OPEN}]);", [(REST + "i@/v1/d/{id}/x", "i@/v1", 0)]),
)
def rest_values(facts):
    """Namespaces, paths and arguments from calls, variables, sprintf and interpolation."""
    return detect.rest(facts)


@by_case(
    "route method callback auth_level",
    ("class A { function go() { if (!current_user_can('edit_posts')) return; register_rest_route('p@/v1', '/a', $this->args); } }", [(REST + "p@/v1/a", "GET", "property:$this->args", 2)]),
    (f"class A {{ function go() {{ register_rest_route('p@/v1', '/b', [['methods' => 'POST', 'callback' => [$this, 'm'], {OPEN}]]); }} }}", [(REST + "p@/v1/b", "POST", "this::m", 0)]),
    (f"class A {{ function go() {{ $this->api->register_rest_route('p@/v1', '/c', ['callback' => [$this, 'm'], {OPEN}]); }} }}", [(REST + "p@/v1/c", "GET", "this::m", 0)]),
)
def rest_property_args(facts):
    """Arguments held by a property, arrays of definitions and calls on a property."""
    return detect.rest(facts)


@by_case(
    "route method",
    ("class A { protected $namespace = 'r@/v1'; function go() { $this->registerGetRoute('/a', [$this, 'm']); $this->registerPostRoute('/b', [$this, 'n']); } }", [(REST + "r@/v1/a", "GET"), (REST + "r@/v1/b", "POST")]),
    ("class A { protected $namespace = 'r@/v1'; function go() { $this->registerDeleteRoute('/c', [$this, 'm']); $this->registerPutRoute('/d', [$this, 'n']); $this->registerPatchRoute('/e', [$this, 'n']); } }", [(REST + "r@/v1/c", "DELETE"), (REST + "r@/v1/d", "PUT"), (REST + "r@/v1/e", "PATCH")]),
)
def rest_verb_methods(facts):
    """Methods that name the verb."""
    return detect.rest(facts)


@by_case(
    "route method callback auth_level",
    ("class C@ extends Base { protected $namespace = 'c@/v1'; function getRoutePath() { return '/items'; } function getMethods() { return 'POST'; } function permissionCallback() { return current_user_can('manage_options'); } }", [(REST + "c@/v1/items", "POST", "C@::getRoutePath", 5)]),
    ("class D@ extends Base { protected $namespace = 'd@/v1'; function getRoutePath() { return '/open'; } function permissionCallback() { return true; } }", [(REST + "d@/v1/open", "GET", "D@::getRoutePath", 0)]),
    ("class E@ { const API_NAMESPACE = 'e@/v1'; const ROUTE_PATH = '/fixed'; }", [(REST + "e@/v1/fixed", "GET", "array_defined", 5)]),
)
def rest_controllers(facts):
    """Controllers that name their route themselves."""
    return detect.controllers(facts)


@by_case(
    "route callback",
    (f"register_rest_route('b@/v1', '/a(?P<id>\\d+)', ['args' => ['x' => ['default' => '), [']], 'callback' => 'f', {OPEN}]);", [(REST + "b@/v1/a(?P<id>\\d+)", "f")]),
    (f"register_rest_route('b@/v1', '/b', array('args' => array(array(1, 2), f(g(3))), 'callback' => array('K', 'm'), {OPEN}));", [(REST + "b@/v1/b", "K::m")]),
    (f"/* register_rest_route('no', '/no', []); */ // register_rest_route('no')\nregister_rest_route('b@/v1', '/c', ['callback' => function ($r) {{ return [')', \"]\"]; }}, {OPEN}]);", [(REST + "b@/v1/c", "closure")]),
)
def rest_balanced_arguments(facts):
    """Nested brackets, brackets in strings, and comments."""
    return detect.rest(facts)


@by_case(
    "route auth_level",
    ("class W@ { function add@($path, $methods, $callback) { register_rest_route('ow/v@', $path, ['methods' => $methods, 'callback' => $callback, 'permission_callback' => '__return_true']); } function go() { $this->add@('/a', 'POST', 'f'); } }", [(REST + "ow/v@/a", 0)]),
    ("class W@ { function add@($path, $callback) { register_rest_route('ow/v@', $path, ['callback' => $callback, 'permission_callback' => [$this, 'may']]); } function may() { return current_user_can('manage_options'); } function go() { $this->add@('/b', 'f'); } }", [(REST + "ow/v@/b", 5)]),
    ("class W@ { function add@($path, $callback) { register_rest_route('ow/v@', $path, ['callback' => $callback, 'permission_callback' => [$this, 'may']]); } function may() { return true; } function go() { $this->add@('/c', 'f'); $this->add@('/d', 'g'); } }", [(REST + "ow/v@/c", 0), (REST + "ow/v@/d", 0)]),
    ("class W@ { function add@($path, $callback) { register_rest_route('ow/v@', $path, ['callback' => $callback, 'permission_callback' => 'elsewhere@']); } function go() { $this->add@('/e', 'f'); } }", [(REST + "ow/v@/e", 1)]),
)
def rest_wrapper_calls(facts):
    """Calls of REST wrappers; the level is the permission callback's."""
    return detect.wrapper_calls(facts)


@by_case(
    "route auth_level",
    ("register_rest_route('q@/v1', '/a', ['callback' => 'fa@', 'permission_callback' => 'pa@']); function pa@() { return current_user_can('manage_options'); } function fa@() { return true; }", [(REST + "q@/v1/a", 0)]),
    ("register_rest_route('q@/v1', '/b', ['callback' => 'fb@', 'permission_callback' => 'pb@']); function pb@() { return current_user_can('manage_options'); } function fb@() { return current_user_can('edit_posts'); }", [(REST + "q@/v1/b", 2)]),
)
def rest_compat_levels(facts):
    """With ``compat`` a handler's own returns lower the level."""
    return detect.rest(facts, compat=True)


# AJAX shapes


@by_case(
    "route auth_level",
    ("$p = 'a'; add_action('wp_ajax_' . $p . '_b@', 'f');", [(AJAX + "a_b@", 1)]),
    ("class A { protected $name = 'pr@'; function go() { add_action('wp_ajax_nopriv_' . $this->name, [$this, 'm']); } }", [(AJAX + "pr@", 0)]),
    ("class A { private $name = 'in@'; function go() { add_action(\"wp_ajax_{$this->name}_x\", [$this, 'm']); } }", [(AJAX + "in@_x", 1)]),
    ("$kind = 'kd@'; add_action(\"wp_ajax_$kind\", 'f');", [(AJAX + "kd@", 1)]),
    ("add_action('wp_ajax_' . $unknown, 'f@');", [(AJAX + "{unknown}", 1)]),
)
def ajax_names(facts):
    """Hook names from concatenations, properties and interpolations."""
    return detect.ajax(facts)


@by_case(
    "route callback auth_level",
    ("add_action('wp_ajax_cl@', function () { if (!current_user_can('manage_options')) wp_die(); });", [(AJAX + "cl@", "closure", 5)]),
    ("add_action('wp_ajax_nopriv_cn@', function () { echo 1; });", [(AJAX + "cn@", "closure", 0)]),
    ("add_action('wp_ajax_nopriv_ar@', fn() => is_user_logged_in());", [(AJAX + "ar@", "closure", 1)]),
)
def ajax_closures(facts):
    """Closures as callbacks, with the level of their bodies."""
    return detect.ajax(facts)


@by_case(
    "route auth_level",
    ("add_action('woocommerce_api_pay@', 'f');", [("?wc-api=pay@", 0)]),
    ("add_action('wc_ajax_nopriv_wn@', 'f');", [("?wc-ajax=wn@", 0)]),
    ("add_action('admin_action_nopriv_an@', 'f');", [(AJAX + "an@", 0)]),
)
def ajax_other_prefixes(facts):
    """WooCommerce and admin-action hooks."""
    return detect.ajax(facts)


@by_case(
    "route callback auth_level",
    ("add_filter('heartbeat_received', 'f@'); add_filter('heartbeat_settings', 'g@');", [(AJAX + "received", "f@", 1)]),
    ("add_filter('heartbeat_nopriv_send', 'f@'); add_filter('heartbeat_tick', 'g@');", [(AJAX + "send", "f@", 0)]),
    ("add_filter('heartbeat_send', [$this, 'm@']);", [(AJAX + "send", "this::m@", 1)]),
    ("add_filter('heartbeat_received', 'f@'); add_filter('heartbeat_nopriv_received', 'h@');", [(AJAX + "received", "f@", 0), (AJAX + "received", "h@", 0)]),
    ("add_action('heartbeat_received', 'f@'); add_filter('wp_ajax_flt@', 'g@'); add_action('wp_ajax_act@', 'h@');", [(AJAX + "act@", "h@", 1)]),
)
def ajax_heartbeat(facts):
    """Of the heartbeat's filters, received and send with their public forms are endpoints; filters of other names are none."""
    return detect.ajax(facts)


@by_case(
    "route callback auth_level",
    ("class L { function go() { $this->loader->add_action('wp_ajax_ld@', $plugin_admin, 'save'); } }", [(AJAX + "ld@", "plugin_admin::save", 1)]),
    ("$loader->addAction('wp_ajax_nopriv_ln@', $front, 'show');", [(AJAX + "ln@", "front::show", 0)]),
    ("Hooks::addAction('wp_ajax_st@', 'f');", [(AJAX + "st@", "f", 1)]),
    ("$hooks->addAction('wp_ajax_ch@', [$this, 'a'])->addAction('wp_ajax_nopriv_ci@', [$this, 'b']);", [(AJAX + "ch@", "this::a", 1), (AJAX + "ci@", "this::b", 0)]),
)
def ajax_loaders(facts):
    """Loaders, static calls and chains."""
    return detect.ajax(facts)


@by_case(
    "route callback auth_level",
    ("$ajax->register_ajax_action('el@', [$this, 'm']);", [(AJAX + "elementor_ajax&actions=el@", "this::m", 1)]),
    ("acf_register_ajax('ac@', 'f', true);", [(AJAX + "acf/ac@", "f", 0)]),
    ("acf_register_ajax('manage_@', 'f');", [(AJAX + "acf/manage_@", "f", 5)]),
    ("$fs->add_ajax_action('sdk@', [&$this, 'm']);", [(AJAX + "fs_sdk@", "this::m", 5)]),
    ("class A { function go() { $this->registerAjaxNopriv('ra@', 'f'); $this->registerAjax('rb@', 'g'); } }", [(AJAX + "ra@", "f", 0), (AJAX + "rb@", "g", 1)]),
)
def ajax_frameworks(facts):
    """Registrations of page builders, field plugins and SDKs."""
    return detect.ajax(facts)


@by_case(
    "route auth_level",
    ("add_action('wp_ajax_nopriv_da@', [$this, 'ha@']); class A { function ha@() { $this->ck@(); } function ck@() { if (!current_user_can('edit_others_posts')) die; } }", [(AJAX + "da@", 4)]),
    ("add_action('wp_ajax_nopriv_db@', 'hb@'); function hb@() { Guard::ask@(); } class Guard { static function ask@() { check_ajax_referer('x'); } }", [(AJAX + "db@", 1)]),
    ("add_action('wp_ajax_nopriv_dc@', 'hc@'); function hc@() { check_ajax_referer('x'); }", [(AJAX + "dc@", 0)]),
    ("add_action('wp_ajax_nopriv_dd@', 'hd@'); function hd@() { if (!is_user_logged_in()) die; }", [(AJAX + "dd@", 1)]),
)
def ajax_delegated_levels(facts):
    """Public callbacks that ask in their body, or one call deep; a nonce counts in a delegate only."""
    return detect.ajax(facts)


@by_case(
    "route auth_level raw_code",
    ("add_action('wp_ajax_co@', 'f'); add_action('wp_ajax_nopriv_co@', 'f');", [(AJAX + "co@", 0, "add_action('wp_ajax_co@', 'f') [also-nopriv]"), (AJAX + "co@", 0, "add_action('wp_ajax_nopriv_co@', 'f')")]),
    ("add_action('admin_post_nopriv_cp@', 'f');", [(POST + "cp@", 0, "add_action('admin_post_nopriv_cp@', 'f')")]),
)
def ajax_correlation(facts):
    """Subscriber rows with a public twin."""
    return detect.ajax(facts)


# Other detectors


@by_case(
    "route callback auth_level",
    ("add_action('template_redirect', 'ta@'); function ta@() { if ($_GET['down@']) { is_user_logged_in(); } }", [("/?action=down@", "ta@", 1)]),
    ("add_action('parse_request', 'tb@'); function tb@() { if (get_query_var('feed@')) {} }", [("/feed@", "tb@", 0)]),
    ("add_action('template_redirect', 'tc@'); function tc@() { echo 1; }", [("/template-redirect:tc@", "tc@", 0)]),
)
def template_redirects(facts):
    """Routes that a handler's body names by the field or query variable it reads."""
    return detect.framework(facts).where("namespace in ('template_redirect', 'parse_request')")


@by_case(
    "route auth_level",
    ("add_rewrite_endpoint('ep@', EP_ROOT);", [("/ep@", 0)]),
    ("register_taxonomy('tx@', 'post', ['show_in_rest' => true]);", [(REST + "wp/v2/tx@", 0), (REST + "wp/v2/tx@", 4)]),
)
def endpoints_and_taxonomies(facts):
    return detect.framework(facts)


@by_case(
    "route auth_level namespace",
    *[(f"{call}('T', 'T', 'manage_options', 'pg@', 'f');", [("wp-admin/admin.php?page=pg@", 5, call)]) for call in ("add_options_page", "add_posts_page", "add_media_page", "add_comments_page", "add_users_page")],
    ("add_menu_page('T', 'T', 'read', 'pg@', 'fm@'); function fm@() { if (!current_user_can('edit_posts')) die; }", [("wp-admin/admin.php?page=pg@", 2, "add_menu_page")]),
)
def menu_functions(facts):
    """All menu functions; the callback's body raises the level."""
    return detect.admin_pages(facts)


@by_case(
    "class_name method_name param_index prefix is_static",
    ("class R { public static function reg@($hook, $cb) { add_action('wp_ajax_' . $hook, $cb); } }", [("R", "reg@", 0, "wp_ajax_", True)]),
    ("function plain@($a, $b, $hook) { add_filter($hook, $a); }", [("", "plain@", 2, "", False)]),
)
def wrapper_prefixes(facts):
    """Wrappers with a fixed prefix, static methods and functions."""
    return detect.wrappers(facts)


# Facts: levels, callbacks, arguments, symbols


@by_case(
    "name level guard returns",
    ("function a@() { if (!is_super_admin()) die; }", [("a@", 5, 5, 1)]),
    ("function b@() { if (!is_user_logged_in()) die; return true; }", [("b@", 1, 1, 0)]),
    ("function c@() { return current_user_can('edit_posts'); }", [("c@", 2, 2, 2)]),
    ("function d@($u) { return user_can($u, 'moderate_comments') ? 1 : false; }", [("d@", 4, -1, 1)]),
    ("function e@() { return false; }", [("e@", 0, -1, 5)]),
    ("function f@() { if (get_current_user_id() === 0) die; }", [("f@", 1, 1, 1)]),
    ("function g@() { if (!$user->has_cap('manage_network')) die; check_ajax_referer('x'); }", [("g@", 6, -1, 1)]),
    ("function h@() { return apply_filters('x', current_user_can(apply_filters('cap', 'manage_options'))); }", [("h@", 5, -1, 1)]),
)
def function_levels(facts):
    """Levels of bodies by capability, admin and login checks; of guards; of returns."""
    return facts.functions.select("name", F.col("level").cast("int").alias("level"), F.coalesce("guard", F.lit(-1)).cast("int").alias("guard"), F.col("returns").cast("int").alias("returns"))


@by_case(
    "callback",
    *[
        (f"add_action('init', {code});", [(name,)])
        for code, name in [("'f@'", "f@"), ("[$this, 'm@']", "this::m@"), ("array('K', 'm@')", "K::m@"), ("[__CLASS__, 'm@']", "this::m@"), ("[Ns\\K::class, 'm@']", "K::m@"), ("[new Q(), 'm@']", "Q::m@"), ("[$obj, 'm@']", "obj::m@"), ("'\\\\Ns\\\\f@'", "Ns\\f@"), ("f@(...)", "f@"), ("$cb", "dynamic_callback"), ("g() . 'x'", "unknown"), ("'K::m@'", "K::m@")]
    ],
)
def callback_forms(facts):
    """Names of callbacks in all their forms."""
    return facts.calls.where("callee = 'add_action'").select(F.col("callbacks")[1].alias("callback"))


@by_case(
    "args vals",
    ("go('a', [1, 'b, c'], f(2, 3), \"d@\");", [("'a' | [1, 'b, c'] | f(2, 3) | \"d@\"", "a | {dynamic} | {dynamic} | d@")]),
    ("go('x' . 'y@', (3));", [("'x' . 'y@' | (3)", "xy@ | 3")]),
    ("go(__('t@', 'dom'), strtolower('q'));", [("__('t@', 'dom') | strtolower('q')", "t@ | q")]),
)
def call_arguments(facts):
    """Arguments at the top level of a call, and their values."""
    return facts.calls.where("callee = 'go'").select(F.array_join("args", " | ").alias("args"), F.array_join("vals", " | ").alias("vals"))


@by_case(
    "kind name value",
    ("class A { const B = 'c@'; public $d = 'e' . '@'; static $s = 't@'; }", [("const", "B", "c@"), ("prop", "d", "e@"), ("static", "s", "t@")]),
    ("define('X', 'y@'); define('Z', X . '/z');", [("define", "X", "y@"), ("define", "Z", "y@/z")]),
    ("class A { const B = 'c@'; const D = self::B . '/d'; }", [("const", "B", "c@"), ("const", "D", "c@/d")]),
    ("class A { function __construct() { $this->late = 'l@'; } }", [("prop", "late", "l@")]),
)
def symbol_values(facts):
    """Constants, properties and defines, resolved over concatenations and references."""
    return facts.symbols.where("kind <> 'var'")


@by_case(
    "route",
    ("$a = 'one@'; add_action('wp_ajax_' . $a, 'f'); $a = 'two@'; add_action('wp_ajax_' . $a, 'f');", [(AJAX + "one@",), (AJAX + "two@",)]),
    ("$a = 'out@'; function g() { $a = 'in@'; add_action('wp_ajax_' . $a, 'f'); }", [(AJAX + "in@",)]),
)
def last_assignments(facts):
    """The last assignment before a call counts, within its function."""
    return detect.ajax(facts)


@by_case(
    "callee enclosing_class enclosing_fn line",
    ("class A {\n function m() {\n  mark(1); } }", [("mark", "A", "m", 4)]),
    ("function f() { return 1; }\nmark(2);", [("mark", "", "", 3)]),
    ("class B { function n() { $f = function () { mark(3); }; } }", [("mark", "B", "closure", 2)]),
)
def enclosing_scopes(facts):
    """The innermost class and function around a call, and its line."""
    return facts.calls.where("callee = 'mark'").withColumn("enclosing_fn", F.regexp_replace("enclosing_fn", "@.*", "")).withColumn("line", F.col("line").cast("int"))


@by_case(
    "fqn parent traits kind",
    ("namespace N@; use Other\\Base as B; class K extends B { use T1, T2; }", [("N@\\K", "Other\\Base", "N@\\T1,N@\\T2", "class")]),
    ("trait T@ { } ", [("T@", "", "", "trait")]),
    ("interface I@ extends J { }", [("I@", "J", "", "interface")]),
)
def class_facts(facts):
    """Qualified names, parents and traits."""
    return facts.classes.withColumn("traits", F.array_join("traits", ","))


@by_case(
    "literals kind",
    ("foreach (['a@', 'b'] as $x) {}", [("a@,b", "inline")]),
    ("$l = ['k' => 'c@']; foreach ($l as $k => $v) {}", [("c@", "variable")]),
    ("class A { private $names = ['d@', 'e']; function go() { foreach ($this->names as $n) {} } }", [("d@,e", "property")]),
    ("foreach ($this->all() as $x) {}", [("", "method")]),
)
def foreach_sources(facts):
    """Literals that a loop runs over, by the kind of its source."""
    return facts.foreachs.withColumn("literals", F.array_join("literals", ","))


@by_case(
    "kind target",
    ("require_once __DIR__ . '/inc/a@.php';", [("literal", "inc/a@.php")]),
    ("include plugin_dir_path(__FILE__) . 'views/' . $page . '.php';", [("dynamic", "views/.php")]),
    ("require 'b@.php';", [("literal", "b@.php")]),
)
def include_facts(facts):
    """Targets of includes."""
    return facts.includes


# Graphs and reports over facts


@by_case(
    "plugin_slug name n_files",
    ("function same() {} function own@() {}", []),
    sql="SELECT 'n' || s_nationkey AS plugin_slug, 'same' AS name, CAST(count(*) AS INTEGER) AS n_files FROM supplier GROUP BY s_nationkey HAVING count(*) > 1",
)
def ambiguous_names(facts):
    """Names that several files of a plugin define."""
    return graph.ambiguous(facts.functions).withColumn("n_files", F.size("files").cast("int"))


@by_case(
    "root path depth",
    ("function a@() { b@(); c@(); } function b@() { c@(); } function c@() { a@(); }", [("a@", "a@", 0), ("a@", "a@>b@", 1), ("a@", "a@>b@>c@", 2), ("a@", "a@>c@", 1)]),
    ("function a@() { a@(); }", [("a@", "a@", 0)]),
)
def call_trees(facts):
    """Call trees: a path holds no function twice."""
    roots = facts.functions.where("name like 'a%'").select("plugin_slug", F.col("name").alias("root"))
    return graph.call_paths(facts.functions, roots).withColumn("path", F.array_join("path", ">")).withColumn("depth", F.col("depth").cast("int"))


@by_case(
    "root path",
    ("function a@() { b@(); c@(); } function b@() { d@(); } function c@() {} function d@() {}", [("a@", "a@"), ("a@", "a@>b@"), ("a@", "a@>b@>d@")]),
)
def node_budget(facts):
    """The first nodes of a tree in pre-order, up to its bound."""
    roots = facts.functions.where("name like 'a%'").select("plugin_slug", F.col("name").alias("root"))
    return graph.call_paths(facts.functions, roots, budget=3).withColumn("path", F.array_join("path", ">"))


@by_case(
    "name chain_level",
    ("function p@() { return zeta@() || alpha@(); } function zeta@() { return current_user_can('manage_options'); } function alpha@() { return current_user_can('edit_posts'); }", [("p@", 5)]),
    ("class K@ { function q@() { return helper@() || $this->inst@() || self::stat@(); } function inst@() { return current_user_can('edit_posts'); } static function stat@() { return current_user_can('manage_options'); } } function helper@() { return current_user_can('read'); }", [("q@", 5)]),
    ("function r@() { return check_permission_of@(); }", [("r@", 1)]),
    ("function t@() { return plain@() || can_do@(); } function plain@() { return deep@(); } function deep@() { return current_user_can('edit_posts'); } function can_do@() { return 1; }", [("t@", 2), ("plain@", 2)]),
    ("function u@() { return can_go@() || late@(); } function can_go@() { return empty_@(); } function empty_@() {} function late@() { return current_user_can('manage_options'); }", [("u@", 1)]),
)
def capability_order(facts):
    """Capabilities are looked for in static, instance and plain calls, each in the order of the text; names that ask for a permission count, too."""
    return graph.capability_chain(facts.functions)


def _edges(facts):
    return dispatch.call_edges(dispatch.resolved(facts, hooks=detect.hook_calls(facts)))


@by_case(
    "src dst",
    ("class A@ { function go() { $this->init(); } function init() { one@(); } } class B@ { function init() { two@(); } } function one@() {} function two@() {}", [("A@::go", "A@::init"), ("A@::init", "one@"), ("B@::init", "two@")]),
    ("class P@ { function go() { $this->act(); } function act() {} } class Q@ extends P@ { function act() { parent::act(); } }", [("P@::go", "P@::act"), ("P@::go", "Q@::act"), ("Q@::act", "P@::act")]),
    ("class R@ { function run() {} } class S@ { private $r; function __construct() { $this->r = new R@(); } function a(R@ $x) { $x->run(); } function b() { $y = new R@(); $y->run(); } function c() { $this->r->run(); } function d() { R@::run(); self::a(1); } }", [("S@::a", "R@::run"), ("S@::b", "R@::run"), ("S@::c", "R@::run"), ("S@::d", "R@::run"), ("S@::d", "S@::a")]),
    ("class T@ { function far@() {} } class U@ { function go($any) { $any->far@(); } }", [("U@::go", "T@::far@")]),
    ("function v@() { call_user_func('w@'); call_user_func_array(['X@', 'm'], []); do_action('own_@'); } function w@() {} class X@ { static function m() {} function on() {} function reg() { add_action('own_@', [$this, 'on']); } }", [("v@", "w@"), ("v@", "X@::m"), ("v@", "X@::on")]),
)
def call_dispatch(facts):
    """Calls reach methods by their receiver's class: that class's own, those below, a parent's; callbacks and fired hooks are calls."""
    return _edges(facts)


@by_case(
    "src dst",
    ("trait T@ { function m() { $this->own(); } } class A@ { use T@; function go() { $this->m(); } function own() {} }", [("A@::go", "T@::m"), ("T@::m", "A@::own")]),
    ("trait T@ { function m() {} } class A@ { use T@ { m as protected alias; } function go() { $this->alias(); } }", [("A@::go", "T@::m")]),
    ("trait T@ { function m() { one@(); } } trait U@ { function m() { two@(); } } class A@ { use T@, U@ { U@::m insteadof T@; T@::m as old; } function go() { $this->m(); } function back() { self::old(); } } function one@() {} function two@() {}", [("A@::go", "U@::m"), ("A@::back", "T@::m"), ("T@::m", "one@"), ("U@::m", "two@")]),
    ("trait T@ { function m() {} } trait V@ { use T@; } class A@ { use V@; } class B@ extends A@ { function go() { $this->m(); } }", [("B@::go", "T@::m")]),
    ("trait T@ { function m() {} } class A@ { use T@; function m() {} function go() { $this->m(); } }", [("A@::go", "A@::m")]),
)
def trait_methods(facts):
    """Methods from traits: own ones first, insteadof, aliases, traits of traits, inheritance."""
    return _edges(facts)


@by_case(
    "route function_calls",
    ("class A@ { function reg() { add_action('wp_ajax_x@', [$this, 'go']); } function go() { $this->init(); } function init() { one@(); } } class B@ { function init() { two@(); } } function one@() {} function two@() {}", [(AJAX + "x@", "A@::init,one@")]),
    ("trait T@ { function m() { one@(); } } class A@ { use T@ { m as save; } function reg() { add_action('wp_ajax_t@', [$this, 'save']); } } function one@() {}", [(AJAX + "t@", "one@")]),
)
def endpoint_dispatch(facts):
    """Endpoints with all that their callbacks reach, calls resolved by receiver."""
    return report.attach_chains(detect.ajax(facts), facts.functions, graph.Reach(facts)).withColumn("function_calls", F.array_join("function_calls", ","))


@by_case("name called_by", ("function a@() { c@(); } function b@() { c@(); } function c@() {}", [("c@", "a@,b@")]))
def callers(facts):
    return graph.callers(facts.functions).withColumn("called_by", F.array_join("called_by", ","))


@by_case("route function_calls", ("add_action('wp_ajax_x@', 'a@'); function a@() { b@(); } function b@() { c@(); } function c@() {}", [(AJAX + "x@", "b@,c@")]))
def endpoint_chains(facts):
    """Endpoints with all that their callbacks reach."""
    return report.attach_chains(detect.ajax(facts), facts.functions).withColumn("function_calls", F.array_join("function_calls", ","))


@by_case(
    "hook is_prefix callback",
    ("add_action('own_@', 'f');", [("own_@", False, "f")]),
    ("add_action('dyn@_' . $x, 'g');", [("dyn@_", True, "g")]),
)
def hook_registry(facts):
    """Hooks by name, or by the part before a placeholder."""
    return graph.hook_registry(detect.hook_calls(facts))


@by_case(
    "ref file",
    ("class Own@ {} new Own@();", [("Own@", "s@.php")]),
    ("new Nowhere@();", []),
)
def class_files(facts):
    """Files that declare what a file names."""
    refs = facts.calls.where("receiver_kind = 'new'").select("plugin_slug", F.col("receiver").alias("ref")).distinct()
    return graph.class_files(facts.files.select("plugin_slug", "file"), facts.classes, refs)


@by_case(
    "line auth_level",
    ("// one\n\nif (current_user_can('edit_posts')) {\nregister_rest_route('w@/v1', '/a', $this->p);\n}", [(5, 2)]),
    ("\n\n\n\nregister_rest_route('w@/v1', '/a', $this->p);", [(6, 0)]),
)
def context_levels(facts):
    """What stands around a call says its level where nothing else does."""
    return detect.rest(facts).withColumn("line", F.col("line").cast("int"))


@by_case(
    "route tag",
    ("register_rest_route($ns@, '/r', ['callback' => 'c', 'permission_callback' => '__return_true']);", [(REST + "{ns@}/r", "[dynamic:unresolved:ns@]")]),
    ("class A { protected $sp@ = 'v@/x'; }\nregister_rest_route($sp@, '/r', ['callback' => 'c', 'permission_callback' => '__return_true']);", [(REST + "v@/x/r", "[resolved-from-property:sp@]")]),
)
def resolve_other_sources(facts):
    """Placeholders from properties; what stays unknown gets a tag."""
    return report.resolve_routes(detect.rest(facts), facts).withColumn("tag", F.regexp_extract("raw_code", r"(\[(?:resolved|dynamic)[^\]]*\])$", 1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
