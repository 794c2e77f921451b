"""Calls resolved by receiver: method tables with traits and inheritance, class-hierarchy dispatch, includes by argument.

A node of the call graph is ``Class::method``, where the class declares the method, or a function's name.
Which node a call reaches follows from its receiver: ``$this``, ``self`` and ``static`` may be of any class
below the one around the call (or, in a trait, of any class that uses it), a variable of the class it was
made of or declared as, or of one below that; ``Cls::m``, ``parent::m`` and ``new Cls`` name their class. A receiver
that nothing is known of reaches the methods of that name of all the plugin's classes.

All tables are keyed by plugin and made by joins; classes' ancestors and nested traits are short loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

CALLBACK = r"^(?:[A-Za-z_\\]\w*::)?[A-Za-z_]\w*$"
EXTENSIONS = ["", ".php", ".html.php"]  # of files that an argument may name


def node_of(cls: str = "class_fqn", name: str = "name") -> Column:
    return F.when(F.col(cls) != "", F.concat(cls, F.lit("::"), name)).otherwise(F.col(name))


def last_segment(name: str) -> Column:
    return F.element_at(F.split(F.col(name), r"\\"), -1)


def known_names(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(plugin_slug, name, known): the class a name stands for, itself or the least with the same last segment."""
    have = classes.select("plugin_slug", F.col("fqn").alias("fqn"), last_segment("fqn").alias("short")).distinct()
    met = wanted.select("plugin_slug", "name").distinct().withColumn("short", last_segment("name")).join(have, ["plugin_slug", "short"])
    return met.groupBy("plugin_slug", "name").agg(F.coalesce(F.max(F.when(F.col("fqn") == F.col("name"), F.col("fqn"))), F.min("fqn")).alias("known"))


def trait_uses(classes: DataFrame) -> DataFrame:
    """(plugin_slug, class, trait, pos): traits in order of use."""
    used = classes.select("plugin_slug", F.col("fqn").alias("class"), F.posexplode("traits").alias("pos", "name"))
    return used.join(known_names(classes, used), ["plugin_slug", "name"]).select("plugin_slug", "class", F.col("known").alias("trait"), "pos")


def with_traits(classes: DataFrame, own: DataFrame) -> DataFrame:
    """Methods (plugin_slug, class, method, decl, name) of classes and those their traits give them.

    A class's own method comes before a trait's, ``insteadof`` leaves methods out, ``as`` adds them under a further name,
    and of traits that still give the same method the first used counts. Traits of traits are followed.
    """
    uses = trait_uses(classes)
    rules = classes.select("plugin_slug", F.col("fqn").alias("class"), F.explode("rules").alias("r")).select("plugin_slug", "class", "r.*")
    named = rules.select("plugin_slug", F.col("trait").alias("name")).where("name <> ''").unionByName(rules.select("plugin_slug", F.explode("instead").alias("name")))
    known = known_names(classes, named)
    left_out = rules.where("size(instead) > 0").select("plugin_slug", "class", "method", F.explode("instead").alias("name")).join(known, ["plugin_slug", "name"]).select("plugin_slug", "class", "method", F.col("known").alias("trait"))
    added = rules.where("alias <> ''").withColumnRenamed("trait", "name").join(known, ["plugin_slug", "name"], "left").select("plugin_slug", "class", F.col("method"), "alias", F.col("known").alias("only"))
    table = graph._write(own, "methods")
    while True:
        given = uses.join(table.withColumnRenamed("class", "trait").hint("merge"), ["plugin_slug", "trait"])
        plain = given.join(left_out, ["plugin_slug", "class", "method", "trait"], "left_anti").select("plugin_slug", "class", "method", "decl", "name", "pos")
        alias = given.join(added, ["plugin_slug", "class", "method"]).where("only is null or only = trait").select("plugin_slug", "class", F.col("alias").alias("method"), "decl", "name", "pos")
        new = plain.unionByName(alias).groupBy("plugin_slug", "class", "method").agg(F.min(F.struct("pos", "decl", "name")).alias("m"))
        new = new.join(table.hint("merge"), ["plugin_slug", "class", "method"], "left_anti")
        new = graph._write(new.select("plugin_slug", "class", "method", "m.decl", "m.name"), "methods")
        if new.isEmpty():
            return table
        table = table.unionByName(new)


class Methods:
    """Method tables of a fact base; each is written once."""

    def __init__(self, facts):
        classes, functions = facts.classes, facts.functions.where("not is_closure")
        own = functions.where("class_fqn <> ''").select("plugin_slug", F.col("class_fqn").alias("class"), F.col("name").alias("method"), F.col("class_fqn").alias("decl"), "name").distinct()
        self.classes, self.functions = classes, functions
        self.parents = graph._write(graph.class_edges(classes), "class-edges")
        self.uses = graph._write(trait_uses(classes), "trait-uses")
        table = with_traits(classes, own) if not self.uses.isEmpty() else own
        up = self.parents.select("plugin_slug", F.col("child").alias("src"), F.col("parent").alias("dst"))
        roots = classes.select("plugin_slug", F.col("fqn").alias("root"))
        flat = roots.distinct().select("plugin_slug", "root", F.col("root").alias("node"), F.lit(0).alias("depth"))
        some = not up.isEmpty()
        chain = graph.closure(up, roots) if some else flat
        near = Window.partitionBy("plugin_slug", "root", "method").orderBy("depth")
        met = chain.join(table.withColumnRenamed("class", "node").hint("merge"), ["plugin_slug", "node"]).withColumn("n", F.rank().over(near)).where("n = 1")
        #: (plugin_slug, class, method, decl, name): what a method's name means in a class, with what it inherits
        self.table = graph._write(met.select("plugin_slug", F.col("root").alias("class"), "method", "decl", "name"), "method-table")
        mixed = up.unionByName(self.uses.select("plugin_slug", F.col("class").alias("src"), F.col("trait").alias("dst")))
        below = graph.closure(mixed, roots) if not self.uses.isEmpty() else chain
        #: (plugin_slug, type, method, decl, name): what it may mean for a receiver of a type: the type's method, or one of a class below
        self.virtual = graph._write(below.select("plugin_slug", F.col("node").alias("type"), F.col("root").alias("class")).join(self.table, ["plugin_slug", "class"]).select("plugin_slug", "type", "method", "decl", "name").distinct(), "method-dispatch")

    @property
    def nodes(self) -> DataFrame:
        """(plugin_slug, node, file)."""
        return self.functions.select("plugin_slug", node_of().alias("node"), "file").distinct()


def _node() -> Column:
    return F.concat("decl", F.lit("::"), "name").alias("dst")


def calls_of(facts) -> DataFrame:
    """(plugin_slug, file, off, holders, class_fqn, kind, type, method, args, vals) of calls, and of callbacks given to call_user_func."""
    calls = facts.calls.where("callee <> '__direct_action'")
    base = ["plugin_slug", "file", "off", "holders", "class_fqn"]
    plain = calls.select(*base, F.col("receiver_kind").alias("kind"), "type", F.when(F.col("receiver_kind") == "new", "__construct").otherwise(F.col("callee")).alias("method"), "args", "vals")
    given = calls.where("callee in ('call_user_func', 'call_user_func_array') and size(callbacks) > 0").withColumn("cb", F.col("callbacks")[0]).where(F.col("cb").rlike(CALLBACK))
    head, none = F.regexp_extract("cb", "^(.*)::", 1), F.array().cast("array<string>")
    kind = F.when(head == "", "none").when(head == "this", "this").otherwise("static")
    return plain.unionByName(given.where("cb not in ('unknown', 'dynamic_callback')").select(*base, kind.alias("kind"), head.alias("type"), F.regexp_extract("cb", "([^:]+)$", 1).alias("method"), none.alias("args"), none.alias("vals")))


def fired_calls(facts, methods: Methods, hooks: DataFrame) -> DataFrame:
    """(plugin_slug, file, off, holders, args, vals, dst): what hooks that the plugin fires itself reach, among ``hooks`` that it registers."""
    fired = facts.calls.where("callee in ('do_action', 'apply_filters') and size(vals) > 0").withColumn("fired", F.col("vals")[0]).where("fired <> ''")
    reached = graph.fired(fired.select("plugin_slug", "fired").distinct(), graph.hook_registry(hooks))
    nodes = roots(reached, methods)
    met = fired.join(reached.join(nodes, ["plugin_slug", "file", "callback"]).select("plugin_slug", "fired", F.col("node").alias("dst")).distinct(), ["plugin_slug", "fired"])
    return met.select("plugin_slug", "file", "off", "holders", "args", "vals", "dst")


def resolved(facts, methods: Methods | None = None, hooks: DataFrame | None = None) -> DataFrame:
    """Calls with the node each may reach: (plugin_slug, file, off, holders, args, vals, dst)."""
    methods = methods or Methods(facts)
    calls = calls_of(facts).hint("merge")  # a union: what its parts were read from would not say
    keep = ["plugin_slug", "file", "off", "holders", "args", "vals"]
    named = methods.functions.where("class_fqn = ''").select("plugin_slug", F.col("name").alias("method")).distinct()
    plain = calls.where("kind = 'none'").join(named, ["plugin_slug", "method"]).select(*keep, F.col("method").alias("dst"))
    of_class = calls.where("type not in ('', 'parent')").withColumn("name", F.when(F.col("type") == "this", F.col("class_fqn")).otherwise(F.col("type"))).where("name <> ''")
    of_class = of_class.join(known_names(methods.classes, of_class), ["plugin_slug", "name"]).drop("name")
    exact = of_class.where("kind in ('static', 'new') and type <> 'this'").join(methods.table.withColumnRenamed("class", "known"), ["plugin_slug", "known", "method"]).select(*keep, _node())
    open_ = of_class.where("kind not in ('static', 'new') or type = 'this'").join(methods.virtual.withColumnRenamed("type", "known"), ["plugin_slug", "known", "method"]).select(*keep, _node())
    above = calls.where("type = 'parent'").join(methods.parents.select("plugin_slug", F.col("child").alias("class_fqn"), F.col("parent").alias("class")), ["plugin_slug", "class_fqn"]).join(methods.table, ["plugin_slug", "class", "method"]).select(*keep, _node())
    every = methods.functions.where("class_fqn <> ''").select("plugin_slug", F.col("class_fqn").alias("decl"), "name", F.col("name").alias("method")).distinct()
    unknown = calls.where("type = '' and kind = 'var'").join(every, ["plugin_slug", "method"]).select(*keep, _node())
    found = plain.unionByName(exact).unionByName(open_).unionByName(above).unionByName(unknown)
    return found if hooks is None else found.unionByName(fired_calls(facts, methods, hooks))


def call_edges(calls: DataFrame) -> DataFrame:
    """(plugin_slug, src, dst) of resolved calls, without calls of a node by itself."""
    return calls.select("plugin_slug", F.explode("holders").alias("src"), "dst").where("src <> dst").distinct()


def roots(callbacks: DataFrame, methods: Methods) -> DataFrame:
    """(plugin_slug, file, callback, node) of callbacks (plugin_slug, file, callback) as detectors name them.

    ``this::m`` is a method of the classes of its file, ``Cls::m`` of that class; where neither says anything, and for
    plain names that no function has, all methods of the name count.
    """
    asked = callbacks.select("plugin_slug", "file", "callback").distinct()
    asked = asked.withColumn("head", F.regexp_extract("callback", r"^(.*)::", 1)).withColumn("method", F.regexp_extract("callback", r"([^:]+)$", 1))
    asked = asked.where("method <> '' and method not in ('closure', 'unknown', 'inline')")
    classes = methods.classes.select("plugin_slug", "file", F.col("fqn").alias("class"), last_segment("fqn").alias("head")).distinct()
    table = methods.table
    here = asked.where("head in ('this', 'self', 'static')").join(classes.drop("head"), ["plugin_slug", "file"]).join(table, ["plugin_slug", "class", "method"])
    by_class = asked.where("head not in ('', 'this', 'self', 'static')").join(classes.drop("file").distinct(), ["plugin_slug", "head"]).join(table, ["plugin_slug", "class", "method"])
    found = here.select("plugin_slug", "file", "callback", _node()).unionByName(by_class.select("plugin_slug", "file", "callback", _node()))
    plain = asked.where("head = ''").join(methods.functions.where("class_fqn = ''").select("plugin_slug", F.col("name").alias("method")).distinct(), ["plugin_slug", "method"]).select("plugin_slug", "file", "callback", F.col("method").alias("dst"))
    found = found.unionByName(plain).distinct()
    every = methods.functions.where("class_fqn <> ''").select("plugin_slug", F.col("class_fqn").alias("decl"), "name", F.col("name").alias("method")).distinct()
    rest = asked.join(found, ["plugin_slug", "file", "callback"], "left_anti").join(every, ["plugin_slug", "method"]).select("plugin_slug", "file", "callback", _node())
    return found.unionByName(rest).distinct().withColumnRenamed("dst", "node")


def includers(facts, calls: DataFrame) -> DataFrame:
    """(plugin_slug, node, index, origin, hints): functions whose argument ``index`` ends up in an include's path.

    ``origin`` is the file of the include. An argument that a function hands on as it came makes it an includer, too.
    """
    own = facts.includes.where("size(given) > 0 and node <> ''").select("plugin_slug", "node", F.explode("given").alias("index"), F.col("file").alias("origin"), "hints")
    own = graph._write(own, "includers")
    params = facts.functions.where("not is_closure").select("plugin_slug", node_of().alias("src"), "params")
    handed = calls.select("plugin_slug", F.explode("holders").alias("src"), "dst", F.posexplode("args").alias("to", "arg")).where(r"arg rlike '^\\$\\w+$'")
    handed = handed.join(params, ["plugin_slug", "src"]).withColumn("index", F.array_position("params", F.substring("arg", 2, 1 << 20)) - 1).where("index >= 0")
    place = lambda node, index: F.concat(F.col(node), F.lit("#"), F.col(index).cast("string"))
    edges = handed.select("plugin_slug", place("dst", "to").alias("src"), place("src", "index").alias("dst"))
    seeds = own.select("plugin_slug", place("node", "index").alias("root")).distinct()
    if own.isEmpty() or edges.isEmpty():
        return own
    all_ = graph.closure(edges, seeds).join(own.withColumn("root", place("node", "index")).drop("node", "index"), ["plugin_slug", "root"])
    return all_.select("plugin_slug", F.regexp_extract("node", "^(.*)#", 1).alias("node"), F.regexp_extract("node", r"(\d+)$", 1).cast("int").alias("index"), "origin", "hints")


def argument_includes(facts, calls: DataFrame) -> DataFrame:
    """(plugin_slug, src, node, arg, dst): files that literal arguments name where they reach an include.

    An argument may be a file's name or lack ``.php`` or ``.html.php``. Of files with its base name the only one counts, else
    one below a directory that the includer names (in order), or in the includer's own, else one that ends in the argument.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = calls.join(includers(facts, calls).withColumnRenamed("node", "dst"), ["plugin_slug", "dst"])
    value = F.regexp_replace(F.trim(F.coalesce(F.get("vals", F.col("index")), F.lit(""))), r"^(?:\./|/)+", "")
    asked = asked.withColumn("arg", value).where("arg <> '' and not contains(arg, '{')").select("plugin_slug", F.col("file").alias("src"), "holders", "arg", "origin", "hints").distinct()
    own_dir = F.regexp_replace("origin", "/?[^/]*$", "")
    asked = asked.withColumn("hints", F.array_append("hints", own_dir)).withColumn("ask", F.monotonically_increasing_id())
    asked = graph._write(asked, "include-arguments")
    names = F.when(F.col("arg").endswith(".php"), F.array(F.col("arg"))).otherwise(F.array(*[F.concat("arg", F.lit(e)) for e in EXTENSIONS]))
    wanted = asked.select("plugin_slug", "ask", "hints", F.posexplode(names).alias("nth", "name")).withColumn("base", base(F.col("name")))
    files = facts.files.select("plugin_slug", F.col("file").alias("dst"), base(F.col("file")).alias("base"))
    lone = files.groupBy("plugin_slug", "base").agg(F.count("*").alias("n"))
    met = wanted.join(files, ["plugin_slug", "base"]).join(lone, ["plugin_slug", "base"])
    ends = lambda tail: (F.col("dst") == tail) | F.col("dst").endswith(F.concat(F.lit("/"), tail))
    under = F.array_position(F.transform("hints", lambda h: ends(F.when(h == "", F.col("name")).otherwise(F.concat(h, F.lit("/"), "name")))), F.lit(True))
    rank = F.when(F.col("n") == 1, 0).when(under > 0, under).when(ends(F.col("name")), 1 << 20)
    best = met.withColumn("rank", rank).where("rank is not null").groupBy("plugin_slug", "ask").agg(F.min(F.struct("nth", "rank", "dst")).alias("b"))
    return asked.join(best, ["plugin_slug", "ask"]).select("plugin_slug", "src", F.explode_outer("holders").alias("node"), "arg", F.col("b.dst").alias("dst")).distinct()
