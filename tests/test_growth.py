"""Work and memory grow no faster than the tables: what joins send through the driver, how work is dealt out, what is made anew."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from plugscope import queries as Q
from plugscope.operators import dispatch, graph, report
from plugscope.plans import facts as plans


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_manual_routes_are_not_broadcast(spark, monkeypatch):
    """tables of many rows take small files, and still joins do not send them through the driver."""
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 100, raising=False)
    rows = spark.range(300).select(F.concat(F.lit("p"), "id").alias("plugin_slug"), F.lit("rest").alias("type"), F.lit("/wp-json/a/v1/items").alias("route"))
    out = report.match_manual(rows, rows)
    assert "Broadcast" not in plan(out)
    assert {tuple(r) for r in out.select("matched", "score").collect()} == {("/wp-json/a/v1/items", 1.0)} and out.count() == 300


def test_class_files_meet_by_whole_keys(spark):
    """classes do not meet all autoload directories, nor all files of their base name; the results stay."""
    files = [("p", f"lib{i}/src/{d}/W.php") for i in range(30) for d in ("A", "B")] + [("p", "x/A/W.php"), ("p", "Root/R.php"), ("p", "/odd/A/W.php"), ("p", "T/One.php")]
    refs = [("p", r) for r in ("N\\A\\W", "B\\W", "W", "N\\N\\N\\A\\W", "Root\\R", "T_One", "Q\\None")]
    bases = [("p", f"lib{i}/src", 31 - i) for i in range(1, 30)] + [("p", "", 1), ("p", "/odd", 31)]
    schema = "plugin_slug string, file string"
    of = lambda b: graph.class_files(spark.createDataFrame(files, schema), spark.createDataFrame([("p", "Q\\Own", "q.php")], "plugin_slug string, fqn string, file string"), spark.createDataFrame(refs, "plugin_slug string, ref string"), b)
    out = of(spark.createDataFrame(bases, "plugin_slug string, dir string, nth int"))
    assert " [plugin_slug#" in plan(out) and not [line for line in plan(out).splitlines() if "Join [plugin_slug#" in line and "," not in line.split("]")[0]]
    assert {r["ref"]: r["file"] for r in out.collect()} == {"N\\A\\W": "lib29/src/A/W.php", "B\\W": "lib29/src/B/W.php", "N\\N\\N\\A\\W": "/odd/A/W.php", "Root\\R": "Root/R.php", "T_One": "T/One.php"}
    assert {r["ref"]: r["file"] for r in of(None).collect()} == {"N\\A\\W": "/odd/A/W.php", "B\\W": "lib0/src/B/W.php", "N\\N\\N\\A\\W": "/odd/A/W.php", "Root\\R": "Root/R.php", "T_One": "T/One.php"}


def test_gaps_by_blocks_of_lines(spark):
    """any band gives the plain result, and an endpoint takes rows by blocks, not by lines."""
    rng = random.Random(3)
    calls = [("p", f"f{rng.randrange(4)}", rng.choice([None, *range(-5, 700)])) for _ in range(400)]
    ends = [("p", f"f{rng.randrange(3)}", rng.choice([None, *range(-5, 700)])) for _ in range(12)]
    schema = "plugin_slug string, file string, line int"
    c = spark.createDataFrame(calls, schema).withColumns({"callee": F.lit("register_rest_route"), "raw": F.lit(""), "before": F.lit("")})
    e = spark.createDataFrame(ends, schema).withColumn("type", F.lit("rest"))
    for within in (0, 3, 40, 150):
        want = [x for x in calls if not any(y[1] == x[1] and None not in (x[2], y[2]) and abs(x[2] - y[2]) <= within for y in ends)]
        got = report.coverage_gaps(e, c, within)
        assert sorted(map(str, want)) == sorted(str((r["plugin_slug"], r["file"], r["line"])) for r in got.collect())
    assert "block" in plan(got)


def test_classes_are_not_broadcast(spark):
    """classes meet their parents without going through the driver."""
    classes = spark.range(100).select(F.lit("p").alias("plugin_slug"), F.concat(F.lit("C"), "id").alias("fqn"), F.when(F.col("id") >= 3, F.concat(F.lit("C"), F.floor(F.col("id") / 3))).otherwise("").alias("parent"))
    assert "Broadcast" not in plan(graph.class_edges(classes))
    assert graph.subclasses(classes, ["C1"]).count() == 58


def test_files_are_dealt_out_before_parsing(spark, tmp_path):
    """F4, F6, F8, F9, F12: one task's files are parsed by many."""
    files = spark.range(60).coalesce(1).select(F.lit("p").alias("plugin_slug"), F.concat(F.lit("f"), "id").alias("file"), F.lit(b"<?php x();").alias("content"))
    assert plans.build(files, path=str(tmp_path / "facts")).calls.count() == 60
    assert len(list(Path(tmp_path / "facts").glob("part-*.parquet"))) > 4


def test_edges_are_made_once(spark):
    """a closure does not make its edges anew in each step."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(12).select(F.lit("p").alias("plugin_slug"), F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    edges = rows.withColumn("dst", counted("dst"))
    assert graph.closure(edges, rows.select("plugin_slug", F.col("src").alias("root"))).count() == 90
    assert graph.reach(edges, rows.where("src = '0'").select("plugin_slug", F.col("src").alias("node"))).count() == 13
    assert made.value == 24


def test_facts_are_not_broadcast(spark, monkeypatch):
    """fact tables of many rows are joined without going through the driver, and the steps keep their rows."""
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 100, raising=False)
    code = F.concat(F.lit("<?php trait T"), "id", F.lit(" { function m() {} } class A"), "id", F.lit(" { use T"), "id", F.lit("; function go() { $this->m(); } }"))
    facts = plans.build(spark.range(150).select(F.concat(F.lit("n"), F.col("id") % 5).alias("plugin_slug"), F.concat(F.lit("f"), "id").alias("file"), code.cast("binary").alias("content")))
    out = dispatch.call_edges(dispatch.resolved(facts))
    assert "Broadcast" not in plan(out)
    assert out.count() == 150


def test_texts_go_to_python_in_small_batches(spark):
    """comments are blanked a hundred texts at a time; an Arrow batch would hold ten thousand."""
    p = plan(Q.strip_comments_len(spark, "/root/testdata/sf0.001"))
    assert "BatchEvalPython" in p and "ArrowEvalPython" not in p


def test_fuzzy_match_meets_all_routes_of_a_plugin(spark):
    """F1 (r04): manual routes meet all detected routes of their plugin, not one each, and the operator's bound leaves out no score."""
    got = Q.fuzzy_match(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and len({r["plugin_slug"] for r in got}) == 25
    assert {r["score"] for r in got} == {0.5, 0.6, 0.7, 0.8, 1.0, None}
    schema = "plugin_slug string, type string, route string"
    m = spark.createDataFrame([("p", "rest", r) for r in ("/wp-json/a/v1/ring/x1/all", "/wp-json/a/v1/items7", "/none")], schema)
    d = spark.createDataFrame([("p", "rest", r) for r in ("/wp-json/c/ring/w1", "/wp-json/c/ring/w2", "/wp-json/c/rod/w3", "/wp-json/a/v1/items70", "/wp-json/b/v2/items7")], schema)
    want = {("/wp-json/a/v1/ring/x1/all", "/wp-json/c/ring/w2", 0.5), ("/wp-json/a/v1/items7", "/wp-json/a/v1/items70", 0.8), ("/none", None, None)}
    for least in (0.5, 0.0):
        assert {tuple(r) for r in report.match_manual(m, d, least).select("route", "matched", "score").collect()} == want


def test_words_give_parts_of_held_shapes(spark):
    """F1 (r04): pairs of a word and what is within it, as by brute force, from tasks that the words were dealt out to."""
    rng = random.Random(6)
    made = lambda n, most: sorted({("p", "rest", "".join(rng.choice("ab/") for _ in range(rng.randrange(0, most)))) for _ in range(n)})
    words, inner = made(60, 9), made(40, 6)
    of = lambda rows: spark.createDataFrame(rows, "plugin_slug string, type string, key string")
    got = report._inside(of(words).where("key <> ''"), of(inner), "key")
    assert "REPARTITION_BY_NUM" in plan(got)
    assert {(r["word"], r["inner"]) for r in got.collect()} == {(w[2], i[2]) for w in words if w[2] for i in inner if i[2] in w[2]}
