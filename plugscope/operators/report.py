"""After detection: route resolution, dedup, coverage, summaries, filters, validation and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import words as W
from . import fold, graph

KEY = ["plugin_slug", "file"]


def resolve_routes(endpoints: DataFrame, facts) -> DataFrame:
    """Placeholders of routes: constants, then properties, then foreach sources (one row a value); else a tag."""
    ep = endpoints.withColumn("ph", R.placeholder(F.col("route")))
    one = lambda kinds, name: facts.symbols.where(F.col("kind").isin(*kinds) & (F.col("value") != "") & ~F.contains("value", F.lit("{"))).groupBy("plugin_slug", F.col("name").alias("ph")).agg(F.max_by("value", F.struct("file", "off")).alias(name))
    loops = facts.foreachs
    methods = facts.functions.groupBy("plugin_slug", F.col("name").alias("source")).agg(F.array_distinct(F.flatten(F.collect_list("literals"))).alias("returned"))
    loops = loops.join(methods, ["plugin_slug", "source"], "left").withColumn("values", F.when(F.col("kind") == "method", F.coalesce("returned", F.array())).otherwise(F.col("literals")))
    by_loop = loops.withColumn("ph", F.explode(F.array_distinct(F.array("loop_var", "loop_key")))).where("ph <> '' and size(values) > 0").groupBy(*KEY, "ph").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))
    ep = ep.join(one(["const", "define"], "const_value"), ["plugin_slug", "ph"], "left").join(one(["prop", "static"], "prop_value"), ["plugin_slug", "ph"], "left").join(by_loop, [*KEY, "ph"], "left")
    value = F.when(F.col("const_value").isNotNull(), F.array("const_value")).when(F.col("prop_value").isNotNull(), F.array("prop_value")).when(F.size("values") > 0, F.col("values"))
    tag = F.when(F.col("const_value").isNotNull(), "resolved-from-constant").when(F.col("prop_value").isNotNull(), "resolved-from-property").otherwise("resolved-from-dynamic")
    rows = ep.withColumn("value", F.explode_outer(F.when(F.col("ph") != "", value)))
    label = F.when(F.col("value").isNotNull(), F.concat(F.lit(" ["), tag, F.lit(":"), F.col("ph"), F.lit("]"))).when(F.col("ph") != "", F.concat(F.lit(" [dynamic:unresolved:"), F.col("ph"), F.lit("]"))).otherwise("")
    route = F.when(F.col("value").isNotNull(), F.regexp_replace("route", r"\{[^}]+\}", F.col("value"))).otherwise(F.col("route"))
    return rows.withColumn("raw_code", F.concat("raw_code", label)).withColumn("route", route).select(endpoints.columns)


def generic(callback: Column) -> Column:
    return callback.isin(*W.GENERIC_CALLBACKS)


def dedup(endpoints: DataFrame) -> DataFrame:
    """One row per (plugin, route, method, type): an ordered fold over rows sorted by file and callback.

    A later row replaces the survivor if its level is higher and the survivor's is not 0, or if only
    the survivor's callback says nothing.
    """
    return fold.dedup(endpoints)


def in_order(endpoints: DataFrame) -> DataFrame:
    """Endpoints with ``pos``, their place in their plugin's order."""
    return endpoints.withColumn("pos", F.row_number().over(Window.partitionBy("plugin_slug").orderBy("route", "method", "type", "file", "callback")).cast("int"))


def coverage_gaps(endpoints: DataFrame, calls: DataFrame, within: int = 3) -> DataFrame:
    """REST registrations without an endpoint within some lines: a banded anti join, keyed by blocks of 64 lines.

    The lines near endpoints are bits of a block's word, so rows grow with blocks and not with the band.
    """
    lowest, highest = F.col("line") - within, F.col("line") + within
    ends = endpoints.where("type = 'rest'").select(*KEY, lowest.alias("lo"), highest.alias("hi"), F.explode(F.sequence(F.shiftright(lowest, 6), F.shiftright(highest, 6))).alias("block"))
    bits = F.expr("shiftleft(-1L, cast(greatest(lo - block * 64, 0) as int)) & shiftrightunsigned(-1L, cast(63 - least(hi - block * 64, 63) as int))")
    near = ends.groupBy(*KEY, F.col("block").cast("long").alias("block")).agg(F.bit_or(bits).alias("covered"))
    asked = calls.where("callee = 'register_rest_route'").withColumn("block", F.shiftright("line", 6).cast("long"))
    free = F.col("covered").isNull() | (F.expr("shiftright(covered, cast(pmod(line, 64) as int)) & 1L") == 0)
    return asked.join(near, [*KEY, "block"], "left").where(free).select(*KEY, "line", R.collapse(F.col("raw"), 200).alias("raw_code"), R.gap_reason(F.col("before"), F.col("raw")).alias("reason"))


def coverage(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    total = calls.where("callee = 'register_rest_route'").groupBy("plugin_slug").agg(F.count("*").alias("total_rest_calls"))
    gaps = coverage_gaps(endpoints, calls).groupBy("plugin_slug").agg(F.count("*").alias("gaps"))
    return total.join(gaps, "plugin_slug", "left").select("plugin_slug", "total_rest_calls", F.coalesce("gaps", F.lit(0)).alias("gaps"), (F.col("total_rest_calls") - F.coalesce("gaps", F.lit(0))).alias("detected"))


def summary(endpoints: DataFrame, plugins: DataFrame | None = None) -> DataFrame:
    """One row of counters: total, by level, by type, authenticated, plugins."""
    counts = [F.count_if(F.col("auth_level") == k).alias(f"{n}_count") for k, n in enumerate(W.LEVELS)] + [F.count_if(F.col("type") == t).alias(f"{'admin_pages' if t == 'admin' else t}_count") for t in W.TYPES]
    out = endpoints.agg(F.count("*").alias("total_endpoints"), *counts, F.count_if(F.col("auth_level") >= 1).alias("authenticated_count"))
    listed = plugins.agg(F.count("*").alias("total_plugins")) if plugins is not None else endpoints.agg(F.count_distinct("plugin_slug").alias("total_plugins"))
    return out.join(F.broadcast(listed))  # one row each


def filter_levels(endpoints: DataFrame, levels: list[str] | None = None, authenticated: bool = False) -> DataFrame:
    """Union of level filters; none keeps all; ``user`` means subscriber."""
    wanted = {1 if n == "user" else W.LEVELS.index(n) for n in levels or []} | (set(range(1, 7)) if authenticated else set())
    return endpoints.where(F.col("auth_level").isin(*wanted)) if wanted else endpoints


def level_bounds(endpoints: DataFrame) -> DataFrame:
    """The highest and the lowest level of each plugin."""
    return endpoints.groupBy("plugin_slug").agg(F.max("auth_level").alias("top"), F.min("auth_level").alias("least"))


def by_level(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("auth_level").agg(F.count("*").alias("n")).withColumn("name", R.level_name(F.col("auth_level")))


def _call_graph(endpoints: DataFrame, functions: DataFrame, reach: graph.Reach | None) -> tuple[DataFrame, DataFrame]:
    """Call edges, and the nodes (plugin_slug, file, callback, root) that callbacks start from: by receiver, or by bare names."""
    if reach is not None:
        return reach.calls, reach.roots(endpoints).withColumnRenamed("node", "root")
    name = F.element_at(F.split("callback", "::"), -1)
    return graph.call_edges(functions), endpoints.select("plugin_slug", "file", "callback", name.alias("root")).where("root <> ''").distinct()


def attach_chains(endpoints: DataFrame, functions: DataFrame, reach: graph.Reach | None = None) -> DataFrame:
    """Sorted flat closure of each endpoint's callback, made once for each node; with ``reach`` calls are resolved by receiver."""
    edges, named = _call_graph(endpoints, functions, reach)
    flat = graph.closure(edges, named.select("plugin_slug", "root").distinct()).where("depth > 0")
    calls = named.join(flat, ["plugin_slug", "root"]).groupBy("plugin_slug", "file", "callback").agg(F.array_sort(F.collect_set("node")).alias("function_calls"))
    return endpoints.join(calls, ["plugin_slug", "file", "callback"], "left").withColumn("function_calls", F.coalesce("function_calls", F.array().cast("array<string>")))


def as_json(endpoints: DataFrame) -> DataFrame:
    """One JSON object a row; empty optional fields are left out."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    cols = [F.col(c) for c in ("plugin_slug", "type", "route")] + [blank("method"), R.level_name(F.col("auth_level")).alias("auth_level"), F.col("callback"), F.col("file"), F.col("line"), blank("raw_code"), blank("namespace")]
    cols += [F.when(F.size("function_calls") > 0, F.col("function_calls")).alias("function_calls")] if "function_calls" in endpoints.columns else []
    return endpoints.select(F.to_json(F.struct(*cols)).alias("json"))


def write_report(endpoints: DataFrame, path: str) -> None:
    """JSON lines, partitioned by level."""
    as_json(endpoints).withColumn("auth_level", F.get_json_object("json", "$.auth_level")).write.partitionBy("auth_level").text(path)


def call_trees(endpoints: DataFrame, functions: DataFrame, reach: graph.Reach | None = None) -> DataFrame:
    """Endpoints with ``paths``: the call paths below each callback, in pre-order, made once for each node."""
    edges, named = _call_graph(endpoints, functions, reach)
    trees = graph.call_paths(functions, named.select("plugin_slug", "root"), edges=edges).where("depth > 0")
    # at most NODE_BUDGET rows a root; a callback that several nodes have has the first's tree
    first = named.groupBy("plugin_slug", "file", "callback").agg(F.min("root").alias("root"))
    paths = trees.groupBy("plugin_slug", "root").agg(F.array_sort(F.collect_list(F.slice("path", 2, 1 << 30))).alias("paths"))
    return endpoints.join(first.join(paths, ["plugin_slug", "root"]).drop("root"), ["plugin_slug", "file", "callback"], "left")


def path_match(a: Column, b: Column) -> Column:
    a, b = F.lower(F.replace(a, F.lit("\\"), F.lit("/"))), F.lower(F.replace(b, F.lit("\\"), F.lit("/")))
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def verify_targets(targets: DataFrame, endpoints: DataFrame, reachable: DataFrame) -> DataFrame:
    """Targets (plugin_slug, relative_path) with direct and reachable matches; candidates meet by base name."""
    base = lambda c: F.lower(F.element_at(F.split(F.col(c), "/"), -1))
    t = targets.withColumn("tid", F.monotonically_increasing_id()).withColumn("name", base("relative_path"))

    def met(rows: DataFrame, flag: str) -> DataFrame:
        own = rows.select("plugin_slug", "file").distinct().withColumn("name", base("file"))
        return t.join(own, ["plugin_slug", "name"]).where(path_match(F.col("relative_path"), F.col("file"))).select("tid").distinct().withColumn(flag, F.lit(True))

    counts = endpoints.groupBy("plugin_slug").agg(F.count("*").alias("endpoints_in_plugin"))
    near = t.join(endpoints.select("plugin_slug", "file", F.concat_ws(" ", F.upper("type"), "route").alias("label")).withColumn("name", base("file")), ["plugin_slug", "name"]).where(path_match(F.col("relative_path"), F.col("file")))
    labels = near.groupBy("tid").agg(F.array_sort(F.collect_set("label")).alias("matched_endpoints"))
    out = t.join(met(endpoints, "direct_match"), "tid", "left").join(met(reachable, "in_call_graph"), "tid", "left").join(labels, "tid", "left").join(counts, "plugin_slug", "left")
    direct, graph_hit = F.coalesce("direct_match", F.lit(False)), F.coalesce("in_call_graph", F.lit(False))
    return out.select(*targets.columns, direct.alias("direct_match"), graph_hit.alias("in_call_graph"), (direct | graph_hit).alias("reachable"), F.coalesce("endpoints_in_plugin", F.lit(0)).alias("endpoints_in_plugin"), F.coalesce("matched_endpoints", F.array().cast("array<string>")).alias("matched_endpoints"))


def _inside(holders: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """Pairs of words (plugin_slug, type, word, inner) where ``inner`` of ``held`` is part of ``word`` of ``holders``.

    Words give their parts of the lengths that ``held`` has in the plugin and type, with a first slash at the same place: an
    equi-join, in which a common beginning meets nothing but itself. Words are dealt out before they give their parts.
    """
    group = ["plugin_slug", "type"]
    spark = holders.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = held.select(*group, F.col(name).alias("inner")).distinct()
    lengths = own.where("inner is not null").groupBy(*group, F.locate("/", "inner").alias("slash")).agg(F.collect_set(F.length("inner")).alias("ns"))
    sizes = lengths.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("slash", "ns"))).alias("sizes"))  # as many as lengths and places, few
    words = holders.select(*group, F.col(name).alias("word")).distinct().join(sizes, group).repartition(tasks, *group, "word")
    rest = words.select(*group, "sizes", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).withColumn("rest", F.expr("substring(word, i)")).withColumn("slash", F.locate("/", "rest"))
    of = lambda slash, ok: F.filter(F.coalesce(F.try_element_at("sizes", slash), F.array().cast("array<int>")), ok)
    whole = of(F.lit(0), lambda n: (n <= F.length("rest")) & ((F.col("slash") == 0) | (n < F.col("slash"))) & ((n > 0) | (F.col("i") == 1)))
    across = F.when(F.col("slash") > 0, of(F.col("slash"), lambda n: n <= F.length("rest"))).otherwise(F.array().cast("array<int>"))
    parts = rest.select(*group, "word", "rest", F.explode(F.concat(whole, across)).alias("n"))
    return parts.select(*group, "word", F.expr("substring(rest, 1, n)").alias("inner")).join(own, [*group, "inner"])


def match_manual(manual: DataFrame, detected: DataFrame, least: float = 0.5) -> DataFrame:
    """Manual rows (plugin_slug, type, route) with their best detected route: exact, else the best score of ``least`` or more.

    A pair's score follows from what its keys share: all of it, one within the other, the last part, or other parts. For each
    of these an inverted index holds the greatest detected route, so rows meet index entries and never all of a plugin's routes.
    """
    group = ["plugin_slug", "type"]
    m = manual.select(*group, "route").distinct().withColumn("key", R.route_key(F.col("route"))).withColumn("norm", R.normal_route(F.col("route")))
    cut = {"parts": F.split("key", "/"), "last": F.element_at(F.split("key", "/"), -1)}
    m = graph._write(m.withColumns(cut), "manual")
    d = detected.select(*group, F.col("route").alias("found")).distinct().join(m.select(*group).distinct(), group, "left_semi")
    d = d.withColumn("key", R.route_key(F.col("found"))).withColumn("norm", R.normal_route(F.col("found")))
    d = graph._write(d.withColumns(cut), "manual-detected")
    met = []

    def on(name: str, score: float, rows: DataFrame, index: DataFrame) -> None:
        """Rows and index entries of one value of ``name``, at a score."""
        top = index.groupBy(*group, name).agg(F.max("found").alias("found"))
        met.append(rows.join(top, [*group, name]).select(*group, "route", F.lit(score).alias("score"), "found"))

    on("norm", 2.0, m, d)
    on("key", 1.0, m.where("key <> ''"), d.where("key <> ''"))
    long = F.length("key") > 3
    for holders, held, turned in ((m, d, False), (d, m, True)):
        whole = _inside(holders.where(long), held.where(long), "key")
        last = _inside(holders.where("length(last) > 5"), held, "last")
        for pairs, name, score in ((whole, "key", 0.8), (last, "last", 0.6)):
            mine, theirs = ("inner", "word") if turned else ("word", "inner")
            top = d.groupBy(*group, F.col(name).alias(theirs)).agg(F.max("found").alias("found"))
            near = graph._write(pairs.join(top, [*group, theirs]).groupBy(*group, F.col(mine).alias(name)).agg(F.max("found").alias("found")), "manual-near")  # one plan of all would fill the driver
            met.append(m.join(near, [*group, name]).select(*group, "route", F.lit(score).alias("score"), "found"))
    on("last", 0.7, m.where("length(last) > 3"), d)
    part = lambda df, *more: df.select(*group, *more, F.size("parts").alias("n"), F.explode("parts").alias("part")).where("length(part) > 2")
    mp, dp = part(m, "route"), part(d, "found")
    often = lambda df, *more: df.groupBy(*group, *more, "part").agg(F.count("*").alias("times")).where("times > 1")
    on("part", 0.6, often(mp, "route"), dp)
    on("part", 0.6, mp, often(dp, "found"))
    words = lambda df: F.array_sort(F.array_distinct(F.filter("parts", lambda p: F.length(p) > 2)))
    twos = lambda df, *more: df.withColumn("w", words(df)).select(*group, *more, F.explode(F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda b: F.concat(a, F.lit("/"), b))))).alias("two"))
    on("two", 0.6, twos(m, "route"), twos(d, "found"))
    on("part", 0.5, mp.where("n <= 2"), dp)
    on("part", 0.5, mp, dp.where("n <= 2"))
    best = reduce(DataFrame.unionByName, met).where(F.col("score") >= least).groupBy(*group, "route").agg(F.max(F.struct("score", "found")).alias("b"))
    return m.join(best, [*group, "route"], "left").select(*group, "route", F.col("b.found").alias("matched"), F.when(F.col("b.score") > 1, 1.0).otherwise(F.col("b.score")).alias("score"))


def validation_metrics(matched: DataFrame) -> DataFrame:
    """Coverage in percent by type; 0 where there is nothing to find."""
    out = matched.groupBy("type").agg(F.count("*").alias("total"), F.count("matched").alias("detected"))
    return out.withColumn("coverage", F.coalesce(F.try_divide(100.0 * F.col("detected"), F.col("total")), F.lit(0.0)))


def auth_accuracy(matched: DataFrame, manual: DataFrame, detected: DataFrame) -> DataFrame:
    """(correct, wrong, accuracy) of the levels of matched routes; 0 where nothing matched."""
    key = ["plugin_slug", "type", "route"]
    truth = manual.select(*key, "level").distinct()
    found = detected.select("plugin_slug", "type", F.col("route").alias("matched"), "auth_level").groupBy("plugin_slug", "type", "matched").agg(F.min("auth_level").alias("auth_level"))
    both = matched.where("matched is not null").join(truth, key).join(found, ["plugin_slug", "type", "matched"])
    right = R.level_value(F.col("level")) == F.col("auth_level")
    out = both.agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(100.0 * F.col("correct"), F.col("correct") + F.col("wrong")), F.lit(0.0)))


def missed_patterns(matched: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent leading parts of routes that nothing matched, a report's limit."""
    pattern = F.array_join(F.slice(F.split(R.normal_route(F.col("route")), "/"), 1, 2), "/")
    return matched.where("matched is null").groupBy("type", pattern.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "pattern").limit(n)


def worst_plugins(matched: DataFrame, n: int = 10) -> DataFrame:
    """Plugins with the least share of matched routes, a report's limit."""
    by = matched.groupBy("plugin_slug").agg(F.count("*").alias("total"), F.count("matched").alias("found"))
    return by.withColumn("coverage", 100.0 * F.col("found") / F.col("total")).orderBy("coverage", F.desc("total"), "plugin_slug").limit(n)


def extra_detected(matched: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected routes that no manual row matched."""
    used = matched.where("matched is not null").select("plugin_slug", "type", F.col("matched").alias("route"))
    return detected.select("plugin_slug", "type", "route").distinct().join(used, ["plugin_slug", "type", "route"], "left_anti")
