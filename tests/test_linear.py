"""Operators that replace all-pairs or whole-group work, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from plugscope.functions import rules as R
from plugscope.functions import words as W
from plugscope.operators import dispatch, fold, graph, report
from plugscope.php.facts import File, facts, header
from plugscope.plans.facts import build


def plain_fold(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[:4], r[4:])):
        groups.setdefault(r[:4], []).append(r)
    out = []
    for own in groups.values():
        best = own[0]
        for x in own[1:]:
            quiet = best[5] in W.GENERIC_CALLBACKS and x[5] not in W.GENERIC_CALLBACKS
            if x[7] > best[7] != 0 or quiet:
                best = x
        out.append(best)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fold_over_tasks(spark, parts):
    """Random rows of a hot route and small ones give the plain fold's, however they are split."""
    rng = random.Random(parts)
    rows = [("p", rng.choice(["/hot"] * 8 + ["/a", "/b", "/c"]), "GET", "rest", f"f{rng.randrange(60)}.php", rng.choice(["unknown", "closure", "cb1", "cb2"]), rng.randrange(5), rng.randrange(7), "") for _ in range(600)]
    schema = "plugin_slug string, route string, method string, type string, file string, callback string, line int, auth_level int, raw_code string"
    got = fold.dedup(spark.createDataFrame(rows, schema).repartition(4), parts)
    assert sorted(map(tuple, got.collect())) == plain_fold(rows)
    assert fold.dedup(spark.createDataFrame([], schema), parts).collect() == []


def test_tables_compose():
    rng = random.Random(1)
    for _ in range(300):
        rows = [rng.choice(fold.STATES) for _ in range(rng.randrange(1, 12))]
        cut = rng.randrange(len(rows) + 1)
        whole, tail = fold._Group(False), fold._Group(True)
        for i, s in enumerate(rows):
            whole.add(s, None, i)
        head = fold._Group(False)
        for i, s in enumerate(rows):
            (head if i < cut else tail).add(s, None, i)
        if head.best is None:
            assert tail.best == whole.best
        else:
            assert tail.table.get(head.best[0], head.best) == whole.best


def test_manual_routes_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["api", "v1", "items", "item", "users", "user", "settings", "set", "a", "save_settings", "xy", "pluginname"]
    route = lambda: rng.choice(["/wp-json/", "", "/"]) + "/".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
    made = lambda n: [(rng.choice("pq"), rng.choice(["rest", "ajax"]), route()) for _ in range(n)]
    m = spark.createDataFrame(made(120), "plugin_slug string, type string, route string")
    d = spark.createDataFrame(made(90), "plugin_slug string, type string, route string")
    got = {r[:3]: (r["matched"], r["score"]) for r in report.match_manual(m, d).collect()}
    a = m.distinct().select("plugin_slug", "type", "route", R.route_key(F.col("route")).alias("key"), R.normal_route(F.col("route")).alias("norm"))
    b = d.distinct().select("plugin_slug", "type", F.col("route").alias("found"), R.route_key(F.col("route")).alias("fkey"), R.normal_route(F.col("route")).alias("fnorm"))
    score = F.when(F.col("norm") == F.col("fnorm"), 2.0).otherwise(R.fuzzy_score(F.col("key"), F.col("fkey")))
    best = {}
    for r in a.join(b, ["plugin_slug", "type"], "left").withColumn("s", score).collect():
        k = (r["plugin_slug"], r["type"], r["route"])
        best.setdefault(k, None)
        if r["s"] is not None and r["s"] >= 0.5:
            best[k] = max(best[k] or (0, ""), (r["s"], r["found"]))
    assert got == {k: (None, None) if v is None else (v[1], min(v[0], 1.0)) for k, v in best.items()}
    assert len({v[1] for v in got.values()}) >= 5


def test_nesting_index():
    from plugscope.php.facts import Nesting

    rng = random.Random(2)
    for _ in range(100):
        spans, stack = [], [(0, 200)]
        while stack:
            lo, hi = stack.pop()
            if hi - lo > 3 and rng.random() < 0.8:
                a = rng.randrange(lo, hi - 1)
                b = rng.randrange(a + 1, hi)
                spans.append({"off": a, "end_off": b})
                stack += [(lo, a), (a + 1, b), (b, hi)]
        index = Nesting(spans)
        for off in range(200):
            want = sorted((s for s in spans if s["off"] <= off < s["end_off"]), key=lambda s: s["off"] - s["end_off"])
            assert sorted(index.at(off), key=lambda s: s["off"] - s["end_off"]) == want


def test_parse_time_follows_the_text():
    import time

    one = "class C%d { function go($a) { $x = new B(); $x->run('lit'); foreach (['a', 'b'] as $k) { add_action('h' . $k, [$this, 'cb']); } return $this->cb(); } function cb() { return true; } }\n"
    took = []
    for n in (150, 1200):
        start = time.process_time()
        facts("<?php\n" + "".join(one % i for i in range(n)))
        took.append(time.process_time() - start)
    assert took[1] < 8 * 2.5 * max(took[0], 0.05)


def test_headers_far_down_and_long_items():
    text = "<?php\n" + "// filler line\n" * 2000 + "/*\n * Plugin Name: Deep\n * Version: 2\n */\n"
    assert header(text) == {"Plugin Name": "Deep", "Version": "2"}
    value = "x" * 900
    call = File(f"<?php f(['{value}']);").calls[0]
    assert call["items"][0]["val"] == value


def test_argument_flow_is_ranked(spark):
    code = {
        "inc/l.php": "<?php class L { function tpl($n) { $p = 'views/' . $n; include __DIR__ . '/' . $p . '.php'; } function other($n) { $n = 'fixed'; include $n . '.php'; } }",
        "m.php": "<?php $l = new L(); $l->tpl('a'); $l->tpl($dynamic); $l->other('a'); $l->tpl('only');",
        "views/a.php": "<?php", "z/a.php": "<?php", "deep/only.php": "<?php",
    }
    made = build(spark.createDataFrame([("p", f, c.encode()) for f, c in code.items()], "plugin_slug string, file string, content binary"))
    found = dispatch.argument_includes(made, dispatch.resolved(made))
    assert sorted((r["src"], r["arg"], r["dst"]) for r in found.collect()) == [("m.php", "a", "views/a.php"), ("m.php", "only", "deep/only.php")]
    reach = graph.Reach(made)
    ends = spark.createDataFrame([("p", "m.php", "L::tpl")], "plugin_slug string, file string, callback string")
    assert {r["reached"] for r in graph.callback_files(made, ends, reach).collect()} == {"m.php", "inc/l.php", "views/a.php", "deep/only.php"}
