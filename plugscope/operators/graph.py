"""Graph operators: closures over calls, classes and includes, per plugin.

Closures are frontier loops over edge tables keyed by plugin: each step joins the last step's rows
with the edges, which are written once, and keeps what is new, written to the shared folder; a step's work is in proportion to
its new rows. Depth is bounded where the operator has a bound.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import words as W

CHAIN_DEPTH = 5
TAINT_DEPTH = 10
NODE_BUDGET = 10_000


def _write(df: DataFrame, label: str) -> DataFrame:
    from ..plans.facts import shared_dir, written

    return written(df, f"{shared_dir(df.sparkSession)}/plugscope/{label}-{uuid.uuid4().hex}")


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(plugin_slug, root, node, depth): nodes reachable from ``seeds`` (plugin_slug, root) over edges (plugin_slug, src, dst)."""
    edges = _write(edges.select("plugin_slug", "src", "dst").distinct(), "edges")
    front = _write(seeds.select("plugin_slug", "root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    seen, k = front, 0
    while (depth is None or k < depth) and not front.isEmpty():
        k += 1
        step = front.join(edges, (front["plugin_slug"] == edges["plugin_slug"]) & (front["node"] == edges["src"])).select(front["plugin_slug"], "root", F.col("dst").alias("node")).distinct()
        front = _write(step.join(seen.hint("merge"), ["plugin_slug", "root", "node"], "left_anti").select("plugin_slug", "root", "node", F.lit(k).alias("depth")), "closure")
        seen = seen.unionByName(front)
    return seen


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(plugin_slug, node): nodes reachable from any of ``seeds`` (plugin_slug, node) in ``depth`` steps; one row a node, whatever the number of seeds."""
    edges = _write(edges.select("plugin_slug", "src", "dst").distinct(), "edges")
    front = _write(seeds.select("plugin_slug", "node").distinct(), "reach")
    seen, k = front, 0
    while (depth is None or k < depth) and not front.isEmpty():
        k += 1
        step = front.join(edges, (front["plugin_slug"] == edges["plugin_slug"]) & (front["node"] == edges["src"])).select(front["plugin_slug"], F.col("dst").alias("node")).distinct()
        front = _write(step.join(seen.hint("merge"), ["plugin_slug", "node"], "left_anti"), "reach")
        seen = seen.unionByName(front)
    return seen


def call_edges(functions: DataFrame) -> DataFrame:
    """(plugin_slug, src, dst): calls of functions of the plugin; functions of one name share their calls."""
    names = functions.select("plugin_slug", F.col("name").alias("dst")).distinct()
    made = functions.select("plugin_slug", F.col("name").alias("src"), F.explode("calls").alias("dst"))
    return made.where("src <> dst").join(names, ["plugin_slug", "dst"], "left_semi").select("plugin_slug", "src", "dst").distinct()


def callees(functions: DataFrame) -> DataFrame:
    """Sorted callees of each function name, over all definitions."""
    return call_edges(functions).groupBy("plugin_slug", F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("function_calls"))


def callers(functions: DataFrame) -> DataFrame:
    return call_edges(functions).groupBy("plugin_slug", F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("called_by"))


def ambiguous(functions: DataFrame) -> DataFrame:
    """Names that several files define."""
    return functions.groupBy("plugin_slug", "name").agg(F.array_sort(F.collect_set("file")).alias("files")).where("size(files) > 1")


def call_paths(functions: DataFrame, roots: DataFrame, budget: int = NODE_BUDGET, edges: DataFrame | None = None) -> DataFrame:
    """Call trees as rows (plugin_slug, root, path, depth): a path holds no node twice; pre-order rows up to ``budget`` a root."""
    from pyspark.sql import Window

    edges = call_edges(functions) if edges is None else edges
    front = _write(roots.select("plugin_slug", "root", F.array("root").alias("path")).distinct(), "paths")
    out = front
    over = Window.partitionBy("plugin_slug", "root").orderBy("path")
    while True:
        grown = front.join(edges, (front["plugin_slug"] == edges["plugin_slug"]) & (F.element_at("path", -1) == edges["src"])).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(front["plugin_slug"], "root", F.array_append("path", F.col("dst")).alias("path"))
        front = _write(grown.withColumn("n", F.row_number().over(over)).where(F.col("n") <= budget).drop("n"), "paths")  # no more could be kept
        if front.isEmpty():
            break
        out = out.unionByName(front)
    kept = out.withColumn("n", F.row_number().over(over)).where(F.col("n") <= budget)
    return kept.select("plugin_slug", "root", "path", (F.size("path") - 1).alias("depth"))


def capability_chain(functions: DataFrame, depth: int = CHAIN_DEPTH) -> DataFrame:
    """(plugin_slug, file, name, chain_level) of functions whose own body asks for nothing: the first level above 0 in depth-first order of same-file calls.

    Calls are taken as they are looked for: static ones first, then instance ones, then plain ones, each in the order
    of the text. A call whose body says nothing, or is not found, still counts as a subscriber's if its name asks for a
    permission; it comes after all that its body calls.
    """
    own = functions.groupBy("plugin_slug", "file", "name").agg(F.min_by(F.struct("level", "ordered"), "off").alias("f")).select("plugin_slug", "file", "name", "f.level", "f.ordered")
    calls = own.where("level = 0").select("plugin_slug", "file", F.col("name").alias("src"), F.posexplode("ordered").alias("pos", "dst"))
    target = own.select("plugin_slug", "file", F.col("name").alias("dst"), F.col("level").alias("dst_level"))
    edges = calls.join(target, ["plugin_slug", "file", "dst"], "left").withColumn("named", R.is_permission_name(F.col("dst")))
    edges = _write(edges.where(F.col("dst_level").isNotNull() | F.col("named")), "chain")
    found = edges.select("plugin_slug", "file", F.col("src").alias("name"), "dst", F.array("pos").alias("ord"), F.col("dst_level").alias("level"), "named")
    out = found
    for _ in range(1, depth):
        nxt = edges.select("plugin_slug", "file", F.col("src").alias("via"), F.col("dst").alias("to"), "pos", "dst_level", F.col("named").alias("asks"))
        found = found.where("level = 0 and dst <> name").join(nxt, (found["plugin_slug"] == nxt["plugin_slug"]) & (found["file"] == nxt["file"]) & (found["dst"] == nxt["via"])).select(found["plugin_slug"], found["file"], "name", F.col("to").alias("dst"), F.array_append("ord", F.col("pos")).alias("ord"), F.col("dst_level").alias("level"), F.col("asks").alias("named"))
        found = found.groupBy("plugin_slug", "file", "name", "dst").agg(F.min("ord").alias("ord"), F.first("level").alias("level"), F.first("named").alias("named"))
        found = _write(found.select(out.columns), "chain")
        if found.isEmpty():
            break
        out = out.unionByName(found)
    hits = out.where("level > 0").select("plugin_slug", "file", "name", "level", "ord")
    hits = hits.unionByName(out.where("named and coalesce(level, 0) = 0").select("plugin_slug", "file", "name", F.lit(W.SUBSCRIBER).alias("level"), F.array_append("ord", F.lit(1 << 30)).alias("ord")))
    return hits.groupBy("plugin_slug", "file", "name").agg(F.min_by("level", "ord").alias("chain_level"))


def tainted(functions: DataFrame, depth: int = TAINT_DEPTH) -> DataFrame:
    """(plugin_slug, name, guard): functions that read the request themselves or through calls."""
    edges = call_edges(functions).select("plugin_slug", F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = functions.where("reads_input").select("plugin_slug", F.col("name").alias("node"))
    names = reach(edges, seeds, depth).select("plugin_slug", F.col("node").alias("name"))
    guards = functions.groupBy("plugin_slug", "name").agg(F.max("guard").alias("guard"))
    return names.join(guards, ["plugin_slug", "name"])


def class_edges(classes: DataFrame) -> DataFrame:
    """(plugin_slug, child, parent); a parent that only its last name segment finds is the least match."""
    last = lambda c: F.element_at(F.split(F.col(c), r"\\"), -1)
    known = classes.select("plugin_slug", F.col("fqn").alias("known"), last("fqn").alias("short"))
    wanted = classes.where("parent <> ''").select("plugin_slug", F.col("fqn").alias("child"), "parent", last("parent").alias("short"))
    met = wanted.join(known.hint("merge"), ["plugin_slug", "short"], "left").groupBy("plugin_slug", "child", "parent").agg(F.max(F.when(F.col("known") == F.col("parent"), F.col("known"))).alias("exact"), F.min("known").alias("least"))
    return met.select("plugin_slug", "child", F.coalesce("exact", "least", "parent").alias("parent"))


def subclasses(classes: DataFrame, roots: list[str]) -> DataFrame:
    """(plugin_slug, fqn): all descendants of classes whose last name segment is one of ``roots``."""
    edges = _write(class_edges(classes), "class-edges")
    seeds = edges.where(F.element_at(F.split("parent", r"\\"), -1).isin(*roots)).select("plugin_slug", F.col("parent").alias("root")).distinct()
    down = reach(edges.select("plugin_slug", F.col("parent").alias("src"), F.col("child").alias("dst")), seeds.withColumnRenamed("root", "node"))
    return down.join(edges.select("plugin_slug", F.col("child").alias("node")).distinct().hint("merge"), ["plugin_slug", "node"], "left_semi").select("plugin_slug", F.col("node").alias("fqn"))


def method_order(classes: DataFrame) -> DataFrame:
    """Method resolution order (plugin_slug, fqn, pos, node): class, its traits in order, then its parents; a cycle ends it."""
    edges = class_edges(classes)
    up = edges.select("plugin_slug", F.col("child").alias("src"), F.col("parent").alias("dst"))
    chain = closure(up, classes.select("plugin_slug", F.col("fqn").alias("root")))
    own = chain.select("plugin_slug", "root", "node", F.array("depth", F.lit(0)).alias("ord"))
    traits = classes.select("plugin_slug", F.col("fqn").alias("node"), F.posexplode("traits").alias("t", "trait"))
    mixed = chain.join(traits, ["plugin_slug", "node"]).select("plugin_slug", "root", F.col("trait").alias("node"), F.array("depth", F.col("t") + 1).alias("ord"))
    each = own.unionByName(mixed).groupBy("plugin_slug", "root", "node").agg(F.min("ord").alias("ord"))
    from pyspark.sql import Window

    return each.select("plugin_slug", F.col("root").alias("fqn"), (F.row_number().over(Window.partitionBy("plugin_slug", "root").orderBy("ord")) - 1).alias("pos"), "node")


def include_edges(files: DataFrame, includes: DataFrame) -> DataFrame:
    """(plugin_slug, src, dst): includes by suffix of the path, else by a base name that only one file has."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    named = files.select("plugin_slug", F.col("file").alias("dst"), base("file").alias("name"))
    wanted = includes.where("target like '%.php'").select("plugin_slug", F.col("file").alias("src"), "target", base("target").alias("name"))
    met = wanted.join(named, ["plugin_slug", "name"])
    suffix = (F.col("dst") == F.col("target")) | F.col("dst").endswith(F.concat(F.lit("/"), F.col("target")))
    ranked = met.groupBy("plugin_slug", "src", "target").agg(F.collect_set(F.when(suffix, F.col("dst"))).alias("fit"), F.count_distinct("dst").alias("n"), F.min("dst").alias("one"))
    hit = F.when(F.size("fit") > 0, F.col("fit")).when(F.col("n") == 1, F.array("one"))
    return ranked.select("plugin_slug", "src", F.explode(hit).alias("dst")).where("src <> dst").distinct()


def autoload_dirs(facts) -> DataFrame:
    """(plugin_slug, dir, nth): directories that autoloaders start from: those their files assemble from their own, then their own."""
    own = F.regexp_replace("file", "/?[^/]*$", "")
    files = facts.calls.where("callee = 'spl_autoload_register'").select("plugin_slug", "file").distinct()
    made = facts.symbols.where("kind = 'var'").join(files, ["plugin_slug", "file"])
    part = F.regexp_extract("value", r"""^(?:__DIR__|dirname\s*\([^)]+\))\s*\.\s*['"]([^'"]+)['"]""", 1)
    up = F.col("value").rlike(r"^dirname\s*\(\s*(?:__DIR__|dirname)")
    start = F.when(up, F.regexp_replace(own, "/?[^/]*$", "")).otherwise(own)
    below = made.where(part != "").select("plugin_slug", F.trim(F.lit("/"), F.concat_ws("/", start, F.trim(F.lit("/"), part))).alias("dir"), F.struct("file", "off").alias("at"))
    both = below.unionByName(files.select("plugin_slug", own.alias("dir"), F.struct("file", F.lit((1 << 31) - 1).alias("off")).alias("at")))
    first = both.groupBy("plugin_slug", "dir").agg(F.min("at").alias("at"))
    from pyspark.sql import Window

    return first.select("plugin_slug", "dir", F.row_number().over(Window.partitionBy("plugin_slug").orderBy("at")).alias("nth"))


def dirs_of(files: DataFrame) -> DataFrame:
    """(plugin_slug, file, dir): every directory above a file, for equi-joins with directories."""
    parts = F.split("file", "/")
    return files.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).where("dir <> file")


def class_files(files: DataFrame, classes: DataFrame, refs: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Files of referenced classes (plugin_slug, ref, file), by the first of these ways that finds one.

    Declaration; a path below an autoload directory (in order), with up to two leading segments left out; the only file of
    the class's base name; the longest ending of its path; the same with underscores as directories; kebab names.

    All are equi-joins with one row a key: of files with the same ending, or the same path below autoload directories, the
    first is the answer for every class, so a base name or a directory that many share never meets all of them.
    """
    path = F.concat(F.replace("ref", F.lit("\\"), F.lit("/")), F.lit(".php"))
    short = F.element_at(F.split("ref", r"\\"), -1)
    under = F.when(F.contains("ref", F.lit("_")) & ~F.contains("ref", F.lit("\\")), F.concat(F.replace("ref", F.lit("_"), F.lit("/")), F.lit(".php")))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    refs = refs.select("plugin_slug", "ref").distinct()
    rank = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    declared = refs.join(classes.select("plugin_slug", F.col("fqn").alias("ref"), "file"), ["plugin_slug", "ref"]).select("plugin_slug", "ref", "file", rank(F.lit(0), F.lit(0)).alias("r"))
    parts = F.split("file", "/")
    cut_at = lambda k: F.array_join(F.slice(parts, k + 1, 1 << 20), "/")
    lone = files.groupBy("plugin_slug", base(F.col("file")).alias("name")).agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1").drop("n")
    endings = files.select("plugin_slug", "file", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), cut_at)).alias("tail")).groupBy("plugin_slug", "tail").agg(F.min("file").alias("file"))
    tails = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.array_join(F.slice(F.split(p, "/"), k, 1 << 20), "/"))
    by_tail = lambda way, p: F.transform(tails(p), lambda t, k: F.struct(F.lit(way).alias("way"), k.alias("k"), t.alias("tail")))
    keys = F.concat(by_tail(2, path), by_tail(3, F.coalesce(under, path)))
    kebab = F.array(*[F.struct(F.lit(way).alias("way"), F.lit(0).alias("k"), F.concat(F.lit(lead), F.lower(F.replace(short, F.lit("_"), F.lit("-"))), F.lit(".php")).alias("tail")) for way, lead in ((4, ""), (5, "class-"))])
    cand = refs.withColumn("c", F.explode(F.concat(keys, kebab))).select("plugin_slug", "ref", "c.*").withColumn("name", base(F.col("tail")))
    # a base name alone says enough only where it is the only one (ways 2 to 4); a class- name may be repeated
    only = cand.where("way < 5").join(lone, ["plugin_slug", "name"]).select("plugin_slug", "ref", "file", rank(F.col("way"), F.lit(-1)).alias("r"))
    ends = cand.where("tail <> name or way = 5").join(endings, ["plugin_slug", "tail"]).select("plugin_slug", "ref", "file", rank(F.col("way"), F.col("k")).alias("r"))
    both = declared.unionByName(only).unionByName(ends)
    if bases is not None:
        cut = F.transform(F.sequence(F.lit(0), F.least(F.lit(2), F.size(F.split(path, "/")) - 1)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(F.split(path, "/"), k + 1, 1 << 20), "/").alias("tail")))
        splits = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("dir"), cut_at(k).alias("tail")))
        below = files.select("plugin_slug", "file", F.inline(splits)).where("k = 0 or dir <> ''").join(bases, ["plugin_slug", "dir"])
        below = below.groupBy("plugin_slug", "tail").agg(F.min(F.struct("nth", "file")).alias("at"))
        loaded = refs.withColumn("c", F.explode(cut)).select("plugin_slug", "ref", "c.*").join(below, ["plugin_slug", "tail"])
        both = both.unionByName(loaded.select("plugin_slug", "ref", F.col("at.file").alias("file"), rank(F.lit(1), F.col("at.nth") * 3 + F.col("k")).alias("r")))
    return both.groupBy("plugin_slug", "ref").agg(F.min(F.struct("r", "file")).alias("b")).select("plugin_slug", "ref", F.col("b.file").alias("file"))


def hook_registry(hooks: DataFrame) -> DataFrame:
    """(plugin_slug, hook, is_prefix, callback, file): hooks with a placeholder count by their prefix."""
    return hooks.select("plugin_slug", F.regexp_extract("hook", r"^([^{]*)", 1).alias("hook"), F.contains("hook", F.lit("{")).alias("is_prefix"), "callback", "file").where("hook <> ''")


def fired(hook_names: DataFrame, registry: DataFrame) -> DataFrame:
    """Callbacks that hooks (plugin_slug, fired) reach: exact names and registered prefixes.

    Prefixes meet the fired names by an equi-join on their first 4 characters; shorter prefixes on all they have.
    """
    exact = hook_names.join(registry.where("not is_prefix"), (hook_names["plugin_slug"] == registry["plugin_slug"]) & (hook_names["fired"] == registry["hook"])).select(hook_names["plugin_slug"], "fired", "callback", "file")
    names = hook_names.withColumn("cut", F.explode(F.sequence(F.lit(1), F.least(F.length("fired"), F.lit(4))))).withColumn("lead", F.expr("substring(fired, 1, cut)")).select("plugin_slug", "fired", "lead")
    pre = registry.where("is_prefix").withColumn("lead", F.substring("hook", 1, 4))
    by_prefix = names.join(pre, ["plugin_slug", "lead"]).where(F.col("fired").startswith(F.col("hook"))).select("plugin_slug", "fired", "callback", "file")
    return exact.unionByName(by_prefix).distinct()


def core_hooks(hooks: DataFrame) -> DataFrame:
    """Hooks that every request fires; a hook registered by prefix counts if the prefix and a core hook begin alike."""
    lead = F.regexp_extract("hook", r"^([^{]*)", 1)
    alike = F.exists(F.array(*map(F.lit, W.CORE_HOOKS)), lambda c: lead.startswith(c) | c.startswith(lead))
    return hooks.where(F.col("hook").isin(*W.CORE_HOOKS) | (F.contains("hook", F.lit("{")) & (lead != "") & alike))


class Reach:
    """Call and include edges of a fact base, for reachability; each is written once."""

    def __init__(self, facts):
        from . import dispatch
        from .detect import hook_calls

        self.facts, self.methods = facts, dispatch.Methods(facts)
        self.hooks = hook_calls(facts)
        calls = _write(dispatch.resolved(facts, self.methods, self.hooks), "resolved-calls")
        self.calls = dispatch.call_edges(calls)
        self.named = dispatch.argument_includes(facts, calls)
        files = facts.files.select("plugin_slug", "file")
        self.includes = _write(include_edges(files, facts.includes).unionByName(self.named.select("plugin_slug", "src", "dst")).where("src <> dst").distinct(), "include-edges")

    def roots(self, callbacks: DataFrame) -> DataFrame:
        from . import dispatch

        return dispatch.roots(callbacks, self.methods)


def callback_files(facts, endpoints: DataFrame, reach_of: Reach | None = None) -> DataFrame:
    """(plugin_slug, callback, file, reached): the files that each endpoint's callback can reach.

    Calls lead to functions, functions to their files and to files that their arguments name, files to what they include,
    and ``new`` and static references to their classes' files.
    """
    r = reach_of or Reach(facts)
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    calls = r.calls.select("plugin_slug", tag("f:", "src").alias("src"), tag("f:", "dst").alias("dst"))
    held = r.methods.nodes.select("plugin_slug", tag("f:", "node").alias("src"), tag("p:", "file").alias("dst"))
    given = r.named.where("node is not null").select("plugin_slug", tag("f:", "node").alias("src"), tag("p:", "dst").alias("dst"))
    included = r.includes.select("plugin_slug", tag("p:", "src").alias("src"), tag("p:", "dst").alias("dst"))
    news = facts.calls.where("receiver_kind in ('new', 'static') and type not in ('', 'this', 'parent')").select("plugin_slug", F.explode("holders").alias("node"), F.col("type").alias("ref")).distinct()
    by_class = class_files(facts.files.select("plugin_slug", "file"), facts.classes, news, autoload_dirs(facts))
    referred = news.join(by_class, ["plugin_slug", "ref"]).select("plugin_slug", tag("f:", "node").alias("src"), tag("p:", "file").alias("dst"))
    edges = _write(calls.unionByName(held).unionByName(given).unionByName(included).unionByName(referred).distinct(), "reach-edges")
    asked = endpoints.select("plugin_slug", "file", "callback").distinct()
    starts = asked.select("plugin_slug", "file", "callback", tag("p:", "file").alias("root")).unionByName(r.roots(asked).select("plugin_slug", "file", "callback", tag("f:", "node").alias("root")))
    found = closure(edges, starts.select("plugin_slug", "root").distinct()).where("node like 'p:%'")
    return starts.join(found, ["plugin_slug", "root"]).select("plugin_slug", "callback", "file", F.substring("node", 3, 1 << 20).alias("reached")).distinct()


def reachable_files(facts, endpoints: DataFrame, reach_of: Reach | None = None) -> DataFrame:
    """(plugin_slug, file) that a request can reach: endpoints, core hooks, root files, then autoload directories, templates and includes."""
    r = reach_of or Reach(facts)
    files = facts.files.select("plugin_slug", "file")
    core = core_hooks(r.hooks)
    asked = endpoints.select("plugin_slug", "file", "callback").unionByName(core.select("plugin_slug", "file", "callback")).distinct()
    fns = reach(r.calls, r.roots(asked).select("plugin_slug", "node"))
    by_call = fns.join(r.methods.nodes, ["plugin_slug", "node"]).select("plugin_slug", "file")
    seeds = asked.select("plugin_slug", "file").unionByName(by_call).unionByName(files.where("file not like '%/%'")).distinct()
    reached = reach(r.includes, seeds.withColumnRenamed("file", "node")).withColumnRenamed("node", "file")
    # fragments of dynamic includes open their directory; so do the hints of functions that include by argument, and autoload directories
    by_part = facts.includes.where("kind <> 'literal' and target like '%/%'").join(reached, ["plugin_slug", "file"], "left_semi").select("plugin_slug", F.regexp_replace("target", "/[^/]*$", "").alias("dir"))
    by_hint = facts.includes.where("size(given) > 0").join(fns, ["plugin_slug", "node"], "left_semi").select("plugin_slug", F.explode("hints").alias("hint"))
    bases = autoload_dirs(facts)
    dirs = dirs_of(files)
    hinted = dirs.join(by_part.unionByName(bases.where("dir <> ''").select("plugin_slug", "dir")).distinct(), ["plugin_slug", "dir"], "left_semi").select("plugin_slug", "file")
    ends = dirs.withColumn("hint", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), k, 1 << 20), "/"))))
    hinted = hinted.unionByName(ends.join(by_hint.distinct(), ["plugin_slug", "hint"], "left_semi").select("plugin_slug", "file"))
    active = endpoints.select("plugin_slug").distinct()
    parts = F.transform(F.split("file", "/"), F.lower)
    templates = files.where(F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, W.TEMPLATE_DIRS)))).where(F.size(F.split("file", "/")) > 1).join(active, "plugin_slug", "left_semi")
    news = facts.calls.where("receiver_kind in ('new', 'static') and type not in ('', 'this', 'parent')").join(reached, ["plugin_slug", "file"], "left_semi").select("plugin_slug", F.col("type").alias("ref")).distinct()
    by_class = class_files(files, facts.classes, news, bases).select("plugin_slug", "file")
    more = reached.unionByName(hinted).unionByName(templates).unionByName(by_class).distinct()
    return reach(r.includes, more.withColumnRenamed("file", "node")).withColumnRenamed("node", "file")
