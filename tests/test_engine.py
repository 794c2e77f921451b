"""The engine over a small corpus written for these tests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plugscope.config import Config, Profile, capability_dim, guard_level
from plugscope.functions import auth
from plugscope.functions import words as W
from plugscope.operators import detect, graph, report
from plugscope.php.facts import File, header
from plugscope.php.lexer import strip_comments
from plugscope.plans import analyze as A
from plugscope.plans.facts import build
from plugscope.sources import corpus, http, sinks

MAIN = r"""<?php
/*
 * Plugin Name: Demo
 * Version: 1.2
 */
define('DEMO_NS', 'demo/v1');
class Demo {
  const PREFIX = 'demo_';
  private $space = 'demo/v2';
  public function boot() {
    add_action('wp_ajax_nopriv_list', [$this, 'rows']);
    add_action('wp_ajax_list', [$this, 'rows']);
    add_action('wp_ajax_' . self::PREFIX . 'go', array(__CLASS__, 'go'));
    foreach (['one', 'two'] as $k) { add_action('wp_ajax_item_' . $k, [$this, 'rows']); }
    add_action('admin_post_keep', 'demo_keep');
    add_action('admin_post_nopriv_open', 'demo_keep');
    add_action('init', [$this, 'early']);
    // add_action('wp_ajax_commented', 'x');
    $later = array('methods' => WP_REST_Server::EDITABLE, 'callback' => [$this, 'rows'], 'permission_callback' => [$this, 'may']);
    register_rest_route(DEMO_NS, '/things/(?P<id>\d+)', $later);
    register_rest_route($this->space, '/open', [['methods' => 'GET', 'callback' => 'a', 'permission_callback' => '__return_true'], ['methods' => 'POST', 'callback' => 'b', 'permission_callback' => function () { return current_user_can('edit_posts'); }]]);
    register_rest_route('demo/v3', '/none', ['callback' => 'c']);
    register_rest_route('demo/v3', '/shut', ['callback' => 'c', 'permission_callback' => '__return_false']);
    add_menu_page('T', 'T', 'manage_options', 'demo-page', [$this, 'page']);
    add_posts_page('T', 'T', 'edit_posts', 'demo-posts', 'x');
    add_shortcode('demo', [$this, 'tag']);
    register_block_type('demo/box', ['render_callback' => [$this, 'tag']]);
    register_post_type('book', ['show_in_rest' => true, 'rest_base' => 'books']);
    add_rewrite_rule('^shop/([0-9]+)/?$', 'index.php?pagename=shop', 'top');
    include 'inc/extra.php';
  }
  public function may() { return $this->deep(); }
  public function deep() { return current_user_can('manage_options'); }
  public function rows() { return $_POST['x']; }
  public static function go() { check_ajax_referer('n'); }
  public function early() { if (isset($_GET['q'])) { helper(); } }
  public function tag() { return $_POST['field'] . $_GET['g']; }
  public function page() {}
}
function demo_keep() { if (!is_user_logged_in()) { die; } }
function helper() { inner(); }
function wrap($hook, $cb) { add_action('wp_ajax_' . $hook, $cb); }
wrap('wrapped', 'helper');
"""
EXTRA = r"""<?php
namespace Demo\Inc;
class Base extends \WP_Widget { function __construct() { parent::__construct('demo_w', 'W'); } function widget($a, $i) { echo 1; } function form($i) {} }
class Job extends \WP_Background_Process { protected $action = 'demo_job'; }
class Sub extends Job { protected $action = 'sub_job'; use Extra; }
trait Extra {}
function inner() { return $_REQUEST['z']; }
"""
FILES = [("demo", "demo.php", MAIN), ("demo", "inc/extra.php", EXTRA), ("demo", "inc/lost.php", "<?php function lost() {}"), ("demo", "vendor/dep.php", "<?php add_action('wp_ajax_nopriv_dep','x');"), ("demo", "lib/composer.json", "{}"), ("demo", "lib/x.php", "<?php add_action('wp_ajax_nopriv_lib','x');"), ("demo", "raw.PHP", "<?php echo $_GET['a'];"), ("demo", "bin.php", "<?php\0")]


@pytest.fixture(scope="module")
def done(spark):
    files = spark.createDataFrame([(a, b, c.encode()) for a, b, c in FILES], "plugin_slug string, file string, content binary")
    return A.analyze(files)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_comments_keep_length_and_strings():
    s = "a /* x\ny */ 'b // c' // d\n# e\n/* open"
    assert strip_comments(s) == "a     \n     'b // c'     \n   \n/* open"


def test_ajax(done):
    got = {r[0]: r[1] for r in rows(done.endpoints.where("type='ajax'"), "route", "auth_level")}
    base = "wp-admin/admin-ajax.php?action="
    assert got[base + "list"] == 0
    assert got[base + "demo_go"] == 1
    assert got[base + "item_one"] == 1 and got[base + "item_two"] == 1
    assert got["wp-admin/admin-post.php?action=keep"] == 1
    assert got["wp-admin/admin-post.php?action=open"] == 0
    assert got[base + "wrapped"] == 1
    assert got["wp_ajax_nopriv_demo_job"] == 0 and got["wp_ajax_nopriv_sub_job"] == 0
    assert not any("commented" in k or "dep" in k or "lib" in k for k in got)


def test_rest(done):
    got = {(r[0], r[1]): r[2] for r in rows(done.endpoints.where("type='rest'"), "route", "method", "auth_level")}
    assert {m for (r, m) in got if r.startswith("/wp-json/demo/v1/things")} == {"POST", "PUT", "PATCH"}
    assert all(v == 5 for (r, _), v in got.items() if r.startswith("/wp-json/demo/v1/things"))  # through the called method
    assert got[("/wp-json/demo/v2/open", "GET")] == 0
    assert got[("/wp-json/demo/v2/open", "POST")] == 2
    assert got[("/wp-json/demo/v3/none", "GET")] == 0
    assert not any("shut" in r for r, _ in got)
    assert got[("/wp-json/wp/v2/books/{id}", "DELETE")] == 2
    assert got[("/shop/{param1}", "GET")] == 5  # the 500 characters around the call ask for manage_options


def test_other_detectors(done):
    got = {(r[0], r[1]): r[2] for r in rows(done.endpoints.where("type not in ('rest','ajax')"), "type", "route", "auth_level")}
    assert got[("admin", "wp-admin/admin.php?page=demo-page")] == 5
    assert got[("admin", "wp-admin/admin.php?page=demo-posts")] == 2
    assert got[("shortcode", "[demo]")] == 0
    assert got[("block", "block:demo/box:render")] == 0 and got[("block", "block:demo/box:editor")] == 2
    assert got[("widget", "widget:demo_w:render")] == 0 and got[("widget", "widget:demo_w:admin")] == 5
    assert got[("hook_input", "init:this::early")] == 0
    assert got[("direct", "raw.PHP")] == 0


def test_report(done):
    s = done.summary().first()
    assert s["total_endpoints"] == done.endpoints.count() and s["authenticated_count"] == done.authenticated().count()
    p = done.plugins.first()
    assert (p["name"], p["version"], p["files_analyzed"]) == ("Demo", "1.2", 5) and p["errors"] == ["bin.php: binary"]
    gap = done.coverage_gaps().collect()
    assert [g["reason"] for g in gap] == ["complex_expression"] or not gap
    text = "\n".join(sinks.text_report(done.endpoints))
    assert text.startswith("\n" + "=" * 60 + "\nUNAUTHENTICATED ENDPOINTS (") and "GET /wp-json/demo/v2/open -> a" in text and "SHORTCODE [demo] -> this::tag [GET:g, POST:field]" in text
    assert "Unauthenticated: " in sinks.summary_text(s.asDict())
    chains = "\n".join(sinks.chain_report(done.trees()))
    assert "  Callback: this::early" in chains and "    └── helper\n        └── inner" in chains
    full = json.loads("".join(sinks.full_report(done)))
    assert full["summary"]["total_plugins"] == 1 and len(full["endpoints"]["admin"]) == s["admin_count"]
    one = json.loads(report.as_json(done.with_chains().where("route = 'init:this::early'")).first()["json"])
    assert one["auth_level"] == "unauthenticated" and one["function_calls"] == ["helper", "inner"]


def test_reachability(done):
    files = {r["file"] for r in done.reachable_files().collect()}
    assert {"demo.php", "inc/extra.php"} <= files and "inc/lost.php" not in files


def test_graph(spark, done):
    fns = done.facts.functions
    assert ("early", ["helper"]) in [(r["name"], r["function_calls"]) for r in graph.callees(fns).collect()]
    assert ("inner", ["helper"]) in [(r["name"], r["called_by"]) for r in graph.callers(fns).collect()]
    paths = graph.call_paths(fns, spark.createDataFrame([("demo", "early")], "plugin_slug string, root string"))
    assert sorted(r["path"] for r in paths.collect()) == [["early"], ["early", "helper"], ["early", "helper", "inner"]]
    order = {(r["fqn"], r["pos"]): r["node"] for r in graph.method_order(done.facts.classes).collect()}
    assert order[("Demo\\Inc\\Sub", 1)] == "Demo\\Inc\\Extra" and order[("Demo\\Inc\\Sub", 2)] == "Demo\\Inc\\Job"
    assert sinks.render_tree([["b"], ["b", "d"], ["c"]], "") == ["├── b", "│   └── d", "└── c"]
    assert sinks.nested([["b"], ["b", "d"]]) == [{"function": "b", "calls": [{"function": "d"}]}]


def test_dedup_fold(spark):
    cols = detect.ENDPOINT
    base = dict.fromkeys(cols, "") | {"plugin_slug": "p", "type": "ajax", "route": "r", "method": "POST", "line": 1, "off": 0}
    def run(*given):
        rows_ = [tuple((base | g)[c] for c in cols) for g in given]
        df = spark.createDataFrame(rows_, "plugin_slug string, type string, route string, method string, auth_level int, callback string, file string, line int, raw_code string, namespace string, off int")
        return report.dedup(df).select("auth_level", "callback").first()
    assert tuple(run({"auth_level": 0, "callback": "x", "file": "a"}, {"auth_level": 5, "callback": "y", "file": "b"})) == (0, "x")
    assert tuple(run({"auth_level": 1, "callback": "x", "file": "a"}, {"auth_level": 5, "callback": "y", "file": "b"})) == (5, "y")
    assert tuple(run({"auth_level": 1, "callback": "closure", "file": "a"}, {"auth_level": 1, "callback": "y", "file": "b"})) == (1, "y")


def test_dedup_is_the_plain_fold(spark):
    rng = random.Random(3)
    given = [("p", "r", "POST", "ajax", level, f, c) for level, f, c in [(5, "a", "closure"), (3, "b", "named"), (5, "c", "closure")]]
    given += [("p", f"x{rng.randrange(60)}", "POST", "ajax", rng.randrange(7), f"{i:04}", rng.choice(["closure", "inline", "f", "g"])) for i in range(900)]
    want = {}
    for row in sorted(given, key=lambda x: x[5:]):
        old = want.get(row[1])
        if old is None or (row[4] > old[4] and old[4] != 0) or (old[6] in W.GENERIC_CALLBACKS and row[6] not in W.GENERIC_CALLBACKS):
            want[row[1]] = row
    df = spark.createDataFrame(given, "plugin_slug string, route string, method string, type string, auth_level int, file string, callback string")
    got = {r["route"]: tuple(r) for r in report.dedup(df).collect()}
    assert want["r"][4:] == (5, "c", "closure") and got == want


def test_auth_rules():
    c = Config()
    assert auth.infer_level("if (!current_user_can('edit_others_posts')) {}", c) == 4
    assert auth.infer_level("current_user_can('manage_shop_x')", c) == 5
    assert auth.infer_level("wp_verify_nonce($x)", c) == 0 and auth.infer_level("is_admin()", c) == 0
    assert auth.infer_level("is_user_logged_in()", c) == 1
    assert c.capability_level("edit_published_posts") == 4 and c.capability_level_last("edit_published_posts") == 3
    assert guard_level("edit_pages") == 4 and guard_level("x") == 1
    assert auth.guard_in("check_ajax_referer('x')") is None
    assert auth.returns_level("return true;")[0] == 0 and auth.returns_level("return false;")[0] == 5


def test_config(spark):
    c = Config().merge({"custom": {"x": "editor"}, "rest_admin": ["/own"], "admin_patterns": ["own_check"]})
    assert c.capability_level("x") == 4 and c.rest_admin[-1] == "/own" and c.admin_patterns == ("own_check",)
    on = Config().add_profile("p", Profile(enabled=True, ajax_prefixes=("pp_",)))
    off = Config().add_profile("p", Profile(ajax_prefixes=("pp_",))).enable_profile("p")
    assert on.ajax_admin_prefixes == ("pp_",) and off.ajax_admin_prefixes == () and off.profiles["p"].enabled
    assert capability_dim(spark).where("level_cfg <> level_map").count() == 2


def test_header_and_values():
    assert header(" * Plugin Name: A\n// Version: 2") == {"Plugin Name": "A", "Version": "2"}
    f = File("<?php function f(){ $a = 'x'; $b = $a . '_y'; g($b, sprintf('%s/%d', 'p', 3), \"k_{$a}\", $q); }")
    assert f.calls[0]["vals"] == ["x_y", "p/3", "k_x", "{q}"] or f.calls[-1]["vals"] == ["x_y", "p/3", "k_x", "{q}"]


def test_http():
    waits, codes = [], iter([503, 503, 200])
    r = http.Retry(sleep=waits.append).run(lambda: http.Response(next(codes), b"", {}))
    assert r.status == 200 and len(waits) == 2
    with pytest.raises(OSError):
        http.Retry(sleep=waits.append, attempts=15).run(lambda: http.Response(500, b"", {}))
    assert len(waits) == 2 + 14
    assert http.Retry().delay(1, "1") == 1.0
    assert http.Retry(sleep=waits.append).run(lambda: http.Response(404, b"", {})).status == 404


def test_sources(spark, tmp_path):
    root = tmp_path / "all" / "one"
    (root / "sub").mkdir(parents=True)
    (root / "one.php").write_text("<?php\n/*\n * Plugin Name: One\n */ add_action('wp_ajax_nopriv_a','f');")
    (root / "sub" / "B.PHP").write_text("<?php add_action('wp_ajax_b','f');")
    many = A.analyze_directory(spark, str(tmp_path / "all"))
    assert {r["plugin_slug"] for r in many.endpoints.collect()} == {"one"} and many.endpoints.count() == 2
    one = A.analyze_directory(spark, str(root))
    assert one.endpoints.count() == 2 and one.plugins.first()["name"] == "One"
    tsv = tmp_path / "t.tsv"
    tsv.write_text("status\tpath\tplugin\tver\trel\tcve\t5\t6\t7\nFOUND\t/x/plugins/one/one.php\tone\t1\tone.php\tc\t5\t6\t7\nLOST\ta\tb\tc\td\te\tf\tg\th\n")
    t = corpus.targets_tsv(spark, str(tsv)).first()
    assert (t["plugin_dir"], t["relative_path"]) == ("one", "one.php")
    checked = report.verify_targets(spark.createDataFrame([("one", "one.php"), ("one", "zz.php")], "plugin_slug string, relative_path string"), one.endpoints, one.reachable_files())
    assert rows(checked, "relative_path", "direct_match", "reachable") == [("one.php", True, True), ("zz.php", False, False)]
    lines = spark.createDataFrame([("f", 1, "Admin endpoints"), ("f", 2, "/wp-json/a/b"), ("f", 3, "Unauthenticated"), ("f", 4, "wp_ajax_x")], "file string, line_no int, value string")
    assert rows(corpus.manual_truth(lines), "level", "type") == [("admin", "rest"), ("unauthenticated", "ajax")]
    info = spark.createDataFrame([('{"name":"N","requires":false,"tags":[],"sections":{"a":"b"},"downloaded":5}',)], "json string")
    i = corpus.plugin_info(info).first()
    assert (i["name"], i["requires"], i["tags"], i["sections"], i["downloaded"]) == ("N", "", {}, {"a": "b"}, 5)


def test_zip(spark):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("p/a.php", "<?php")
        z.writestr("../evil.php", "<?php")
    got = corpus.unzip(spark.createDataFrame([("p", buf.getvalue())], "plugin_slug string, content binary"))
    assert [r["file"] for r in got.collect()] == ["a.php"]


def test_stream(spark, tmp_path):
    from plugscope.streaming import incremental

    src, out = tmp_path / "src", str(tmp_path / "out")
    files = spark.createDataFrame([("p", "p.php", b"<?php add_action('wp_ajax_nopriv_a','f');")], "plugin_slug string, file string, content binary")
    files.select("plugin_slug").write.parquet(str(src))
    q = incremental.run(spark.readStream.schema("plugin_slug string").parquet(str(src)), lambda: files, out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert incremental.endpoints(spark, out).count() == 1


def test_match_manual(spark):
    m = spark.createDataFrame([("p", "rest", "/wp-json/a/v1/items"), ("p", "rest", "/zzz")], "plugin_slug string, type string, route string")
    d = spark.createDataFrame([("p", "rest", "/wp-json/a/v1/items"), ("p", "rest", "/wp-json/a/v1/other")], "plugin_slug string, type string, route string")
    got = report.match_manual(m, d)
    assert rows(got.where("matched is not null"), "route", "score") == [("/wp-json/a/v1/items", 1.0)]
    assert report.validation_metrics(got).first()["coverage"] == 50.0


def test_sql_functions(spark, done):
    A.register(spark, done)
    assert spark.sql("SELECT php_auth_level('is_super_admin()') AS a").first()["a"] == 5
    assert spark.sql("SELECT callee FROM php_calls('<?php foo(1);')").first()["callee"] == "foo"


def test_php_build_counts(spark):
    files = spark.createDataFrame([("p", "a.php", b"<?php function f(){ g(); }")], "plugin_slug string, file string, content binary")
    assert build(files).functions.select("name", F.size("calls")).first()[:] == ("f", 1)


def test_compat_quirks(spark):
    code = b"""<?php add_action('admin_post_nopriv_a', 'f'); add_action('admin_action_nopriv_b', 'f');
    add_posts_page('T', 'T', 'edit_posts', 's1', 'x'); add_menu_page('T', 'T', 'edit_others_posts', 's2', 'f'); function f() {}"""
    facts = build(spark.createDataFrame([("p", "a.php", code)], "plugin_slug string, file string, content binary"))
    level = lambda df: {r["route"].rpartition("=")[2]: r["auth_level"] for r in df.collect()}
    assert level(detect.ajax(facts)) == {"a": 0, "b": 0}
    assert level(detect.ajax(facts, compat=True)) == {"a": 5}
    assert level(detect.admin_pages(facts)) == {"s1": 2, "s2": 4}
    assert level(detect.admin_pages(facts, compat=True)) == {"s2": 0}


def test_validation(spark):
    m = spark.createDataFrame([("p", "rest", "/wp-json/a/v1/items", "admin"), ("p", "rest", "/zzz/y", "editor"), ("q", "ajax", "wp_ajax_go", "subscriber")], "plugin_slug string, type string, route string, level string")
    d = spark.createDataFrame([("p", "rest", "/wp-json/a/v1/items", 5), ("q", "ajax", "wp-admin/admin-ajax.php?action=go", 0)], "plugin_slug string, type string, route string, auth_level int")
    got = report.match_manual(m, d).cache()
    a = report.auth_accuracy(got, m, d).first()
    assert (a["correct"], a["wrong"], a["accuracy"]) == (1, 1, 50.0)
    assert [r["pattern"] for r in report.missed_patterns(got).collect()] == ["zzz/y"]
    assert report.worst_plugins(got).first()["plugin_slug"] == "p"
    assert report.extra_detected(got, d).count() == 0
    text = "\n".join(sinks.validation_text(report.validation_metrics(got), report.missed_patterns(got), report.worst_plugins(got), report.auth_accuracy(got, m, d)))
    assert "Auth accuracy: 50.0% (1 correct, 1 wrong)" in text and "     1 rest zzz/y" in text


def test_command_line(spark, tmp_path, capsys):
    from plugscope.__main__ import main

    (tmp_path / "a.php").write_text("<?php\n/*\n * Plugin Name: A\n */\nadd_action('wp_ajax_nopriv_x', 'f');")
    assert main(["--analyze", str(tmp_path), "--unauth", "--save", str(tmp_path / "out.json")]) == 0
    assert "AJAX wp-admin/admin-ajax.php?action=x -> f" in capsys.readouterr().out
    assert json.loads((tmp_path / "out.json").read_text())["plugins"][0]["name"] == "A"
    assert main(["--analyze", str(tmp_path), "--chain-json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["auth_level"] == "unauthenticated"


def test_rest_arguments_and_controllers(spark):
    code = b"""<?php class C { private $args; const REST_NAMESPACE = 'c/v1'; function go() { is_super_admin();
    register_rest_route('a/v1', '/held', $this->args); register_rest_route('a/v1', '/lost', $nothing); register_rest_route('a/v1', '/empty', []); } }
    class R { protected $namespace = 'r/v1'; function getRoutePath() { return '/own'; } function getMethods() { return 'POST'; } function checkPermission() { return current_user_can('edit_posts'); } }"""
    facts = build(spark.createDataFrame([("p", "a.php", code)], "plugin_slug string, file string, content binary"))
    got = {r["route"]: (r["auth_level"], r["callback"]) for r in detect.rest(facts).collect()}
    # the 500 characters around the call name a capability, which goes before the admin check
    assert got == {"/wp-json/a/v1/held": (2, "property:$this->args"), "/wp-json/a/v1/empty": (0, "unknown")}
    own = {(r["route"], r["method"], r["auth_level"]) for r in detect.controllers(facts).collect()}
    assert own == {("/wp-json/r/v1/own", "POST", 2)}
