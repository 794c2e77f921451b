"""Detectors: filters and joins over the fact base that give endpoint rows.

Every detector returns ENDPOINT columns plus ``off``, the call's place in its file. Joins are keyed by
(plugin_slug, file) or by plugin, so one hash partitioning by plugin serves all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import rules as R
from ..functions import words as W
from ..plans.facts import Facts, together
from . import graph
from .dispatch import node_of

ENDPOINT = ["plugin_slug", "type", "route", "method", "auth_level", "callback", "file", "line", "raw_code", "namespace", "off"]
KEY = ["plugin_slug", "file"]


def _rows(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    given = {"type": F.lit(kind), "method": F.lit(""), "raw_code": R.collapse(F.col("raw")) if "raw" in df.columns else F.lit(""), "namespace": F.lit(""), **cols}
    return df.select(*[(given[c] if c in given else F.col(c)).alias(c) for c in ENDPOINT]).withColumn("auth_level", F.col("auth_level").cast("int"))


def _arg(n: int, of: str = "vals") -> Column:
    return F.coalesce(F.get(F.col(of), F.lit(n)), F.lit(""))


def callback_facts(facts: Facts) -> DataFrame:
    """First function of each name in a file: what its body says of authentication and input."""
    first = facts.functions.groupBy(*KEY, "name").agg(F.min_by(F.struct("level", "guard", "returns", "reads_input", "fields", "keys", "class", "first_field", "query_var"), "off").alias("body"))
    return first.withColumnRenamed("name", "cb_name")


def with_body(df: DataFrame, bodies: DataFrame, callback: str = "callback") -> DataFrame:
    """Left join with the body of the callback in the same file."""
    return df.withColumn("cb_name", F.element_at(F.split(F.col(callback), "::"), -1)).join(bodies, [*KEY, "cb_name"], "left").drop("cb_name")


def delegated_levels(wanted: DataFrame, facts: Facts) -> DataFrame:
    """(plugin_slug, file, cb_name, asked) of public callbacks ``wanted`` (plugin_slug, file, cb_name).

    The body is looked up in the file, else in the plugin's other files. Where it asks for no level, the
    highest level of the methods it calls counts, one step deep; a nonce in one of them is a subscriber's.
    """
    each = facts.functions.select(*KEY, "name", "off", F.struct("level", "has_nonce", "asks").alias("f"))
    here = each.groupBy(*KEY, "name").agg(F.min_by("f", "off").alias("here"))
    there = each.groupBy("plugin_slug", "name").agg(F.min_by("f", F.struct("file", "off")).alias("there"))

    def body(df: DataFrame, name: str) -> DataFrame:
        named = df.withColumn("name", F.col(name))
        return named.join(here, [*KEY, "name"], "left").join(there, ["plugin_slug", "name"], "left").withColumn("f", F.coalesce("here", "there")).drop("here", "there", "name")

    found = body(wanted.select(*KEY, "cb_name").distinct(), "cb_name").where("f is not null").select(*KEY, "cb_name", F.col("f.level").alias("own"), F.explode_outer(F.when(F.col("f.level") == 0, F.col("f.asks"))).alias("ask"))
    level = F.when(F.col("f.level") > 0, F.col("f.level")).when(F.col("f.has_nonce"), W.SUBSCRIBER).otherwise(0)
    return body(found, "ask").groupBy(*KEY, "cb_name").agg(F.greatest(F.max("own"), F.max(level)).alias("asked"))


def _clean(callback: Column) -> Column:
    return F.when(callback.startswith("closure@"), "closure").otherwise(callback)


def hook_calls(facts: Facts) -> DataFrame:
    """add_action-like calls with hook and callback; a loader's object and method make one callback."""
    calls = facts.calls.where(F.col("callee").isin("add_action", "addAction", "add_filter", "addFilter"))
    loader = (F.col("receiver_kind") != "none") & (F.size("args") >= 3) & F.get("args", F.lit(1)).startswith("$") & F.get("args", F.lit(2)).rlike("^['\"]")
    cb = F.when(loader, F.concat(F.regexp_replace(F.get("args", F.lit(1)), r"^\$", ""), F.lit("::"), _arg(2))).otherwise(_arg(1, "callbacks"))
    return calls.where(F.size("args") >= 1).withColumn("hook", R.clean_interpolation(_arg(0))).withColumn("callback", F.when(cb == "", "unknown").otherwise(cb))


def expand_foreach(hooks: DataFrame, facts: Facts) -> DataFrame:
    """Hooks inside a foreach whose loop variable is in the name: one row per literal of its source."""
    loops = facts.foreachs.where("kind <> 'method'").select(*KEY, F.col("off").alias("loop"), "loop_var", "loop_key", "literals").where(F.size("literals") > 0)
    named = hooks.withColumn("ph", R.placeholder(F.col("hook")))
    inside = named.where("ph <> ''").select(*KEY, "off", "ph", F.explode("loops").alias("loop")).join(loops, [*KEY, "loop"])
    met = inside.where("ph = loop_var or ph = loop_key").select(*KEY, "off", F.explode("literals").alias("literal")).distinct()
    out = named.join(met, [*KEY, "off"], "left")
    return out.withColumn("hook", F.when(F.col("literal").isNotNull(), F.regexp_replace("hook", r"\{[^}]+\}", F.col("literal"))).otherwise(F.col("hook"))).drop("ph", "literal")


def ajax(facts: Facts, config: Config | None = None, bodies: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """AJAX endpoints. With ``compat``, public admin-post hooks count as admin's and public admin actions are lost."""
    config = config or Config()
    bodies = callback_facts(facts) if bodies is None else bodies
    every = hook_calls(facts)
    actions = every.where(F.col("callee").isin("add_action", "addAction"))
    hooks = expand_foreach(actions.where(R.starts_with_any(F.col("hook"), [h[0] for h in W.AJAX_HOOKS])), facts)
    if compat:
        hooks = hooks.where(~F.col("hook").startswith("admin_action_nopriv_")).withColumn("hook", F.regexp_replace("hook", "^admin_post_nopriv_", "admin_post_"))
    hooks = with_body(hooks, bodies).withColumn("cb_name", F.element_at(F.split("callback", "::"), -1))
    public = hooks.where(F.col("hook").startswith("wp_ajax_nopriv_"))
    hooks = hooks.join(delegated_levels(public, facts), [*KEY, "cb_name"], "left").drop("cb_name")
    case = lambda k: reduce(lambda acc, h: acc.when(F.col("hook").startswith(h[0]), F.lit(h[k])), W.AJAX_HOOKS, F.when(F.lit(False), F.lit(W.AJAX_HOOKS[0][k])))
    hooks = hooks.withColumns({"base": case(2), "named": case(3), "rule": case(4), "action": R.ajax_route(F.col("hook"))})
    name = F.regexp_extract("action", "=([^=]*)$", 1)
    own = F.when(F.col("hook").startswith("wp_ajax_nopriv_"), F.col("asked")).otherwise(F.col("body.level"))
    level = F.when((F.col("rule") == "raise") & (own > F.col("base")), own).when((F.col("rule") == "lower") & (own == 1), 1).otherwise(F.col("base"))
    hooks = hooks.withColumn("level", level)
    level = F.when(F.col("named") & (F.col("level") < W.ADMIN) & R.is_admin_action(name, config), W.ADMIN).otherwise(F.col("level"))
    found = [_rows(hooks, "ajax", route=F.col("action"), method=F.lit("POST"), auth_level=level, callback=_clean(F.col("callback")))]
    level = reduce(lambda acc, h: acc.when(F.col("hook") == h[0], h[1]), W.HEARTBEAT, F.when(F.lit(False), 0))
    beats = every.where(F.col("callee").isin("add_filter", "addFilter")).withColumn("level", level).where("level is not null")
    found.append(_rows(beats, "ajax", route=F.concat(F.lit("wp-admin/admin-ajax.php?action="), F.regexp_replace("hook", "^heartbeat_(?:nopriv_)?", "")), method=F.lit("POST"), auth_level=F.col("level"), callback=_clean(F.col("callback"))))
    calls = facts.calls
    bus = calls.where("callee = 'register_ajax_action'")
    found.append(_rows(bus, "ajax", route=R.ajax_route(F.concat(F.lit("elementor_ajax:"), _arg(0))), method=F.lit("POST"), auth_level=F.when(R.is_admin_action(_arg(0), config), W.ADMIN).otherwise(1), callback=_clean(_arg(1, "callbacks"))))
    acf = calls.where("callee = 'acf_register_ajax'")
    public = F.lower(_arg(2, "args")) == "true"
    found.append(_rows(acf, "ajax", route=R.ajax_route(F.concat(F.lit("acf_ajax:"), _arg(0))), method=F.lit("POST"), auth_level=F.when(public, 0).when(R.is_admin_action(_arg(0), config), W.ADMIN).otherwise(1), callback=_clean(_arg(1, "callbacks"))))
    sdk = calls.where("callee in ('add_ajax_action', 'add_ajax_action_static')")
    found.append(_rows(sdk, "ajax", route=F.concat(F.lit("wp-admin/admin-ajax.php?action=fs_"), _arg(0)), method=F.lit("POST"), auth_level=F.lit(W.ADMIN), callback=_clean(_arg(1, "callbacks"))))
    named = calls.where(F.col("callee").rlike("^registerAjax") & (F.col("receiver_kind") != "none") & (F.size("args") >= 2))
    found.append(_rows(named, "ajax", route=F.concat(F.lit("wp-admin/admin-ajax.php?action="), _arg(0)), method=F.lit("POST"), auth_level=F.when(F.lower("callee").contains("nopriv"), 0).when(R.is_admin_action(_arg(0), config), W.ADMIN).otherwise(1), callback=_clean(_arg(1, "callbacks"))))
    direct = calls.where("callee = '__direct_action'")
    found.append(_rows(direct, "ajax", route=F.concat(F.lit("wp-admin/admin-ajax.php?action="), _arg(0)), method=F.lit("POST"), auth_level=F.when((F.col("context_level") < W.ADMIN) & R.is_admin_action(_arg(0), config), W.ADMIN).otherwise(F.col("context_level")), callback=F.lit("inline")))
    found.append(background_jobs(facts))
    return correlate(reduce(DataFrame.unionByName, found))


def background_jobs(facts: Facts) -> DataFrame:
    """Subclasses of background-process and async-request classes with an ``action`` property: public hooks."""
    roots = ["WP_Background_Process", "WP_Async_Request"]
    heirs = graph.subclasses(facts.classes, roots)
    props = facts.symbols.where("name = 'action' and kind in ('prop', 'static')").select(*KEY, F.col("class").alias("name"), F.col("value"), "off")
    rows = facts.classes.select(*KEY, "name", "fqn", "line").join(heirs, ["plugin_slug", "fqn"]).join(props, [*KEY, "name"])
    return _rows(rows, "ajax", route=F.concat(F.lit("wp_ajax_nopriv_"), F.col("value")), method=F.lit("POST"), auth_level=F.lit(0), callback=F.concat("name", F.lit("::handle")))


def correlate(ajax_rows: DataFrame) -> DataFrame:
    """Subscriber and admin rows of a route that is public in the same file become public."""
    over = Window.partitionBy(*KEY, "route")
    public = F.max(F.when(F.col("auth_level") == 0, 1).otherwise(0)).over(over) == 1
    turned = public & F.col("auth_level").isin(W.SUBSCRIBER, W.ADMIN)
    return ajax_rows.withColumns({"raw_code": F.when(turned, F.concat("raw_code", F.lit(" [also-nopriv]"))).otherwise(F.col("raw_code")), "auth_level": F.when(turned, 0).otherwise(F.col("auth_level"))})


_REST_CALLS = ["register_rest_route", "register_route", "_register_route", "REST_Route"]


def rest_calls(facts: Facts) -> DataFrame:
    """Route registrations as (ns, path, arg, items); classes' own namespaces stand in where the call has none."""
    calls = facts.calls
    short = calls["callee"].isin("register_route", "_register_route") & calls["receiver_kind"].isin("this", "static") | ((calls["callee"] == "REST_Route") & (calls["receiver_kind"] == "new"))
    full = calls["callee"] == "register_rest_route"
    verb = F.regexp_extract("callee", "^register(Get|Post|Put|Patch|Delete)Route$", 1)
    rows = calls.where(full | short | (verb != "")).withColumn("short", ~full).withColumn("verb", F.upper(verb))
    own = own_namespaces(facts)
    whole = own.groupBy(*KEY).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"file_{c}") for c in NAMESPACES])
    rows = rows.join(own.drop("at").withColumnRenamed("class", "enclosing_class"), [*KEY, "enclosing_class"], "left").join(whole, KEY, "left")
    order = F.when(F.col("callee") == "REST_Route", 0).when(F.col("receiver_kind") == "static", 1).otherwise(2)
    first = lambda *names: F.coalesce(*names, *[f"file_{n}" for n in names], F.concat("plugin_slug", F.lit("/v1")))
    space = F.when(order == 0, first("root", "const", "prop", "made")).when(order == 1, first("const", "prop", "made", "root")).otherwise(first("made", "prop", "const", "root"))
    return rows.withColumns(
        {
            "ns": F.when(F.col("short"), R.clean_interpolation(space)).otherwise(R.clean_interpolation(_arg(0))),
            "path": R.clean_interpolation(F.when(F.col("short"), _arg(0)).otherwise(_arg(1))),
            "arg": F.when(F.col("short"), 1).otherwise(2),
        }
    )


#: Where a class says its namespace: a get_namespace method, a property, a constant, a root constant.
NAMESPACES = ["made", "prop", "const", "root"]


def own_namespaces(facts: Facts) -> DataFrame:
    """(plugin_slug, file, class, at, made, prop, const, root): what each class says of its routes' namespace, and where it first does."""
    named = facts.symbols.where(F.col("kind").isin("const", "prop", "static", "define")).withColumn("n", F.lower("name"))
    kind = F.when(F.col("n") == "rest_root", "root").when(F.col("n").isin("namespace", "rest_namespace", "api_namespace", "rest_api_namespace", "route_namespace", "ns", "rest_base_namespace"), F.when(F.col("kind").isin("const", "define"), "const").otherwise("prop"))
    said = named.select(*KEY, "class", "off", kind.alias("what"), "value").where("what is not null and value <> ''")
    slugs = facts.functions.where("name = 'get_slug' and size(literals) > 0").groupBy(*KEY, "class").agg(F.min_by(F.col("literals")[0], "off").alias("slug"))
    made = facts.functions.where("name = 'get_namespace' and size(literals) > 0").select(*KEY, "class", "off", F.col("literals")[0].alias("value")).join(slugs, [*KEY, "class"], "left")
    value = F.regexp_replace("value", r"\{?\$this->get_slug\(\)\}?", F.regexp_replace(F.coalesce("slug", "plugin_slug"), r"([\\$])", r"\\$1"))
    said = said.unionByName(made.select(*KEY, "class", "off", F.lit("made").alias("what"), value.alias("value")))
    return said.groupBy(*KEY, "class").agg(F.min("off").alias("at"), *[F.min_by(F.when(F.col("what") == n, F.col("value")), F.when(F.col("what") == n, F.col("off"))).alias(n) for n in NAMESPACES])


def _item(items: Column, group: Column, key: str, field: str) -> Column:
    return F.get(F.transform(F.filter(items, lambda i: (i["grp"] == group) & (i["key"] == key)), lambda i: i[field]), F.lit(0))


def verbs(methods: Column) -> Column:
    """Upper-case methods of a definition; constants of the REST server stand for theirs."""
    names = F.transform(F.split(F.upper(methods), "[,|]"), lambda n: F.trim(n))
    known = F.create_map(*[F.lit(x) for k, v in W.REST_VERBS.items() for x in (k, v)])
    flat = F.flatten(F.transform(names, lambda n: F.split(F.coalesce(known[F.element_at(F.split(n, "::"), -1)], n), ",")))
    return F.filter(flat, lambda n: n != "")


def rest(facts: Facts, config: Config | None = None, bodies: DataFrame | None = None, compat: bool = False) -> DataFrame:
    config = config or Config()
    bodies = callback_facts(facts) if bodies is None else bodies
    rows = rest_calls(facts).where(~F.col("ns").rlike(r"^(array\(|\[)"))
    own = rows.withColumn("own", F.filter("items", lambda i: i["arg"] == F.col("arg")))
    given = F.coalesce(F.get("args", F.col("arg")), F.lit(""))
    held = F.coalesce(F.get("callbacks", F.col("arg")), F.lit("")).startswith("property:")
    # a variable without an array before the call says nothing; a property's array is judged by what surrounds the call
    own = own.withColumn("held", held & (F.size("own") == 0)).where(F.col("short") | F.col("held") | (F.size("own") > 0) | given.rlike(r"(?i)^(\[|array\s*\(|$)"))
    groups = F.array_distinct(F.transform(F.filter("own", lambda i: i["key"].isin("methods", "callback") & (i["grp"] >= 0)), lambda i: i["grp"]))
    rows = own.withColumn("grp", F.explode(F.when(F.size(groups) > 0, groups).otherwise(F.array(F.lit(-1)))))
    defs = rows.withColumns(
        {
            "methods": F.coalesce(_item(F.col("own"), F.col("grp"), "methods", "val"), F.when(F.col("verb") != "", F.col("verb")), F.when(F.col("short") & (F.col("receiver_kind") == "static") & (F.size("own") == 0) & (F.size("args") >= 3), F.regexp_replace(_arg(2, "args"), "['\"]", "")), F.lit("GET")),
            "callback": F.coalesce(_item(F.col("own"), F.col("grp"), "callback", "cb"), F.when(F.col("short"), _arg(1, "callbacks")), F.when(F.col("held"), F.get("callbacks", F.col("arg"))), F.lit("unknown")),
            "perm": _item(F.col("own"), F.col("grp"), "permission_callback", "cb"),
            "perm_code": F.lower(F.trim(_item(F.col("own"), F.col("grp"), "permission_callback", "value"))),
        }
    )
    defs = defs.withColumn("callback", F.when(F.col("callback") == "", "unknown").otherwise(F.col("callback")))
    blocked = F.col("perm").eqNullSafe("__return_false") | F.col("perm_code").eqNullSafe("false")
    if compat:
        blocked = blocked & (F.col("grp") == -1) & ~F.col("short")  # only single definitions are filtered
    chained = graph.capability_chain(facts.functions)
    asked = with_body(defs.where(~blocked), bodies, "perm").withColumnRenamed("body", "perm_body")
    asked = asked.withColumn("cb_name", F.element_at(F.split("perm", "::"), -1)).join(chained.withColumnRenamed("name", "cb_name"), [*KEY, "cb_name"], "left").drop("cb_name")
    name = F.lower("perm")
    admin_name = name.rlike("admin|manage")
    level_of_body = F.when(F.col("perm_body.level") > 0, F.when((F.col("perm_body.level") == 1) & (F.col("chain_level") > 0), F.col("chain_level")).otherwise(F.col("perm_body.level"))).when(F.col("perm_body.returns") == 0, 0).when(F.col("chain_level") > 0, F.col("chain_level")).when(admin_name, W.ADMIN).otherwise(1)
    never = F.col("perm_body.returns") == W.ADMIN
    declared = F.when(F.col("perm").isNull(), F.when(F.col("held"), F.col("context_level")).when(F.col("short") & (F.size("own") == 0), F.when(F.col("verb") != "", F.col("context_level")).otherwise(W.ADMIN)).otherwise(0)).when((F.col("perm") == "__return_true") | (F.col("perm_code") == "true"), 0).when(F.col("perm_body").isNotNull(), level_of_body).when(admin_name, W.ADMIN).otherwise(1)
    closed = F.col("perm").startswith("closure@") & never & (F.col("perm_body.level") == 0)
    asked = asked.where(~F.coalesce(closed, F.lit(False))).withColumn("declared", declared)
    public = (F.col("perm") == "__return_true") | (F.col("perm_code") == "true")
    level = R.route_level(F.col("path"), F.col("ns"), F.col("declared"), F.coalesce(public, F.lit(False)), config)
    level = F.when(F.col("callee") == "_register_route", W.ADMIN).otherwise(level)  # such wrappers take what they allow apart from the arguments
    out = asked.withColumn("level", level)
    if compat:
        out = with_body(out, bodies).withColumn("level", F.least("level", F.when(F.col("callback").rlike(r"[()\[\]$]"), F.col("level")).otherwise(F.coalesce("body.returns", F.lit(1)))))
    out = out.withColumn("verb1", F.explode(verbs(F.col("methods"))))
    return _rows(out, "rest", route=R.rest_route(F.col("ns"), F.col("path")), method=F.col("verb1"), auth_level=F.col("level"), callback=_clean(F.col("callback")), namespace=F.col("ns"))


def controllers(facts: Facts) -> DataFrame:
    """Routes that classes name themselves: a ``getRoutePath`` method, or constants API_NAMESPACE and ROUTE_PATH."""
    ns = facts.symbols.where(F.lower("name").isin("namespace", "rest_namespace", "api_namespace")).groupBy(*KEY, "class").agg(F.max_by("value", "off").alias("ns"))
    fns = facts.functions.where("class <> ''")
    path = fns.where("name = 'getRoutePath' and size(literals) > 0").select(*KEY, "class", "line", "off", F.col("literals")[0].alias("path"))
    verb = fns.where("name in ('getMethods', 'getMethod') and size(literals) > 0").groupBy(*KEY, "class").agg(F.min_by(F.col("literals")[0], "off").alias("verb"))
    asks = fns.where("name in ('permissionCallback', 'getPermissionCallback', 'checkPermission', 'check_permission', 'permissions_check')").groupBy(*KEY, "class").agg(F.max("level").alias("asked"), F.min("returns").alias("least"))
    rows = path.join(ns, [*KEY, "class"], "left").join(verb, [*KEY, "class"], "left").join(asks, [*KEY, "class"], "left")
    level = F.when(F.col("asked") > 0, F.col("asked")).when(F.col("least") == 0, 0).when(F.col("asked").isNotNull(), 1).otherwise(0)
    space = F.coalesce("ns", F.lit("{namespace}"))
    own = _rows(rows.withColumn("m", F.explode(verbs(F.coalesce("verb", F.lit("GET"))))), "rest", route=R.rest_route(space, F.col("path")), method=F.col("m"), auth_level=level, callback=F.concat("class", F.lit("::getRoutePath")), namespace=space)
    const = facts.symbols.where("kind = 'const' and name in ('API_NAMESPACE', 'ROUTE_PATH')").groupBy(*KEY, "class").agg(F.max(F.when(F.col("name") == "API_NAMESPACE", F.col("value"))).alias("ns"), F.max(F.when(F.col("name") == "ROUTE_PATH", F.col("value"))).alias("path"), F.min("off").alias("off"))
    const = const.where("ns is not null and path is not null").join(fns.groupBy(*KEY, "class").agg(F.max(F.when(F.col("returns") == 0, 1).otherwise(0)).alias("open")), [*KEY, "class"], "left")
    listed = _rows(const, "rest", route=R.rest_route(F.col("ns"), F.col("path")), method=F.lit("GET"), auth_level=F.when(F.col("open") == 1, 0).otherwise(W.ADMIN), callback=F.lit("array_defined"), namespace=F.col("ns"), line=F.lit(0))
    return own.unionByName(listed)


# Menu functions, and the places of capability, slug and callback in their arguments.
MENUS = {"add_menu_page": (2, 3, 4), "add_submenu_page": (3, 4, 5)} | {f"add_{n}_page": (2, 3, 4) for n in ("options", "dashboard", "management", "theme", "plugins", "users", "posts", "media", "links", "pages", "comments")}


def admin_pages(facts: Facts, config: Config | None = None, bodies: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Menu pages. With ``compat``, five menu functions give no rows and a found callback collapses levels other than admin and subscriber."""
    config = config or Config()
    menus = [m for m in MENUS if not (compat and m in ("add_posts_page", "add_media_page", "add_links_page", "add_pages_page", "add_comments_page"))]
    rows = facts.calls.where(F.col("callee").isin(*menus) & (F.size("args") >= 4))
    sub = F.col("callee") == "add_submenu_page"
    at = lambda n, of: F.when(sub, _arg(n + 1, of)).otherwise(_arg(n, of))
    rows = rows.withColumns({"cap": at(2, "vals"), "slug": at(3, "vals"), "callback": F.when(at(4, "callbacks") == "", "unknown").otherwise(at(4, "callbacks"))})
    known = F.when(F.lit(False), 0)
    for level, caps in config.core[::-1]:
        known = known.when(F.col("cap").isin(*caps), level)
    for given in (config.extended, config.custom):
        for k, v in given.items():
            known = F.when(F.col("cap") == k, W.LEVELS.index(v)).otherwise(known)
    rows = with_body(rows, callback_facts(facts) if bodies is None else bodies)
    cap, own = F.coalesce(known, F.lit(W.ADMIN)), F.coalesce("body.level", F.lit(0))
    level = F.greatest(cap, own)
    if compat:
        level = F.when(F.col("body").isNull(), cap).when((cap == W.ADMIN) | (own == W.ADMIN), W.ADMIN).when((cap == 1) | (own == 1), 1).otherwise(0)
    ns = F.when(sub, F.concat(F.lit("add_submenu_page:"), _arg(0))).otherwise(F.col("callee"))
    return _rows(rows.where("slug <> ''"), "admin", route=R.admin_route(F.col("slug")), method=F.lit("GET"), auth_level=level, callback=_clean(F.col("callback")), namespace=ns)


def _first(df: DataFrame, *keys: str) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy("off", "line")
    return df.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")


def shortcodes(facts: Facts, bodies: DataFrame | None = None) -> DataFrame:
    rows = facts.calls.where("callee in ('add_shortcode', 'addShortcode') and size(args) >= 2").withColumn("tag", R.clean_interpolation(_arg(0))).withColumn("callback", _arg(1, "callbacks"))
    rows = with_body(_first(rows.where("tag <> ''"), *KEY, "tag"), callback_facts(facts) if bodies is None else bodies)
    route = F.when(F.col("tag").rlike(r"^\{"), F.concat(F.lit("[dynamic:"), F.regexp_replace("tag", r"[{}]", ""), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("tag"), F.lit("]")))
    raw = F.when(F.size("body.fields") > 0, F.concat(F.lit("["), F.array_join("body.fields", ", "), F.lit("]"))).otherwise("")
    return _rows(rows, "shortcode", route=route, method=F.lit("SHORTCODE"), auth_level=F.lit(0), callback=_clean(F.col("callback")), line=F.lit(0), raw_code=raw)


def widgets(facts: Facts) -> DataFrame:
    own = facts.classes.where(F.element_at(F.split("parent", r"\\"), -1) == "WP_Widget").select(*KEY, F.col("name").alias("class"), "line", "off")
    methods = facts.functions.where("class <> ''").select(*KEY, "class", F.col("name").alias("m"), "level", F.size("params").alias("n"))
    ids = facts.calls.where("callee in ('__construct', 'WP_Widget') and receiver in ('parent', '$this') and size(vals) >= 1").groupBy(*KEY, F.col("enclosing_class").alias("class")).agg(F.min_by(_arg(0), "off").alias("id"))
    kept = own.join(methods.where("(m = 'widget' and n >= 2) or m in ('form', 'update')"), [*KEY, "class"]).join(ids, [*KEY, "class"], "left")
    part = F.when(F.col("m") == "widget", "render").otherwise("admin")
    rows = kept.withColumn("part", part).groupBy(*KEY, "class", "line", "off", "id", "part").agg(F.max("level").alias("level"), F.min("m").alias("m"))
    name = F.coalesce(F.when(F.col("id") != "", F.col("id")), F.lower("class"))
    return _rows(rows, "widget", route=F.concat(F.lit("widget:"), name, F.lit(":"), F.col("part")), auth_level=F.when(F.col("part") == "admin", W.ADMIN).otherwise(F.col("level")), callback=F.concat("class", F.lit("::"), "m"))


def blocks(facts: Facts, bodies: DataFrame | None = None) -> DataFrame:
    rows = _first(facts.calls.where("callee = 'register_block_type'").withColumn("name", _arg(0)).where("name like '%/%' and name not like '{%'"), *KEY, "name")
    render = _item(F.filter("items", lambda i: i["arg"] == 1), F.lit(-1), "render_callback", "cb")
    rows = with_body(rows.withColumn("callback", render), callback_facts(facts) if bodies is None else bodies)
    drawn = _rows(rows.where("callback is not null"), "block", route=F.concat(F.lit("block:"), F.col("name"), F.lit(":render")), auth_level=F.coalesce("body.level", F.lit(0)), callback=_clean(F.col("callback")))
    return drawn.unionByName(_rows(rows, "block", route=F.concat(F.lit("block:"), F.col("name"), F.lit(":editor")), auth_level=F.lit(W.CONTRIBUTOR), callback=F.coalesce(_clean(F.col("callback")), F.lit(""))))


def hook_input(facts: Facts, bodies: DataFrame | None = None) -> DataFrame:
    """Early hooks whose callback reads the request, in its file or, through other functions, in the plugin."""
    hooks = hook_calls(facts).where(F.col("hook").isin(*W.INPUT_HOOKS))
    here = with_body(hooks, callback_facts(facts) if bodies is None else bodies)
    near = here.where("body.reads_input").withColumn("level", F.col("body.level"))
    tainted = graph.tainted(facts.functions)
    far = here.where("body is null").drop("body").withColumn("name", F.element_at(F.split("callback", "::"), -1)).join(tainted, ["plugin_slug", "name"]).withColumn("level", F.coalesce("guard", F.lit(0)))
    rows = near.select(*KEY, "hook", "callback", "line", "off", "raw", "level").unionByName(far.select(*KEY, "hook", "callback", "line", "off", "raw", "level"))
    rows = _first(rows, *KEY, "hook", "callback")
    return _rows(rows, "hook_input", route=F.concat("hook", F.lit(":"), _clean(F.col("callback"))), method=F.lit("POST/GET"), auth_level=F.col("level"), callback=_clean(F.col("callback")))


def direct_files(facts: Facts) -> DataFrame:
    dirs = F.split("file", "/")
    rows = facts.files.where("direct").where(~F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*map(F.lit, ["templates", "views", "partials", "vendor", "node_modules"]))))
    return _rows(rows, "direct", route=F.col("file"), method=F.lit("GET/POST"), auth_level=F.lit(0), callback=F.lit(""), line=F.lit(1), off=F.lit(0))


def framework(facts: Facts, config: Config | None = None, bodies: DataFrame | None = None) -> DataFrame:
    config = config or Config()
    calls, found = facts.calls, []
    verb = F.upper("callee")
    http = ["get", "post", "put", "patch", "delete", "any", "match", "options"]
    both = F.when(verb.isin("ANY", "MATCH"), "GET,POST").otherwise(verb)
    path = F.when(F.col("callee") == "match", _arg(1)).otherwise(_arg(0))
    handler = _clean(F.when(F.col("callee") == "match", _arg(2, "callbacks")).otherwise(_arg(1, "callbacks")))
    routed = calls.where(F.col("callee").isin(*http) & (F.size("args") >= 2))
    if config.laravel_routes:
        found.append(_rows(routed.where("receiver_kind = 'static' and receiver = 'Route'"), "rest", route=path, method=both, auth_level=F.lit(1), callback=handler, namespace=F.lit("laravel")))
    if config.generic_routers:
        found.append(_rows(routed.where(F.lower("receiver").isin("$router", "$this->router", "$routes")), "rest", route=path, method=both, auth_level=F.lit(1), callback=handler, namespace=F.lit("router")))
    found.append(_rows(routed.where(F.col("receiver").isin("$app", "$slim", "$this->app") & _arg(0).startswith("/")), "rest", route=path, method=both, auth_level=F.lit(1), callback=handler, namespace=F.lit("slim-framework")))
    fast = calls.where("callee = 'addRoute' and size(args) >= 3")
    found.append(_rows(fast, "rest", route=_arg(1), method=F.upper(_arg(0)), auth_level=F.lit(1), callback=_clean(_arg(2, "callbacks")), namespace=F.lit("fastroute")))
    seen = F.when(F.col("raw_level") > 0, F.col("raw_level")).otherwise(F.col("context_level"))
    rules = calls.where("callee = 'add_rewrite_rule' and size(args) >= 2")
    found.append(_rows(rules, "rest", route=R.rewrite_path(_arg(0)), method=F.lit("GET"), auth_level=seen, callback=R.query_callback(_arg(1)), namespace=F.lit("rewrite")))
    ends = calls.where("callee = 'add_rewrite_endpoint' and size(args) >= 1")
    found.append(_rows(ends, "rest", route=F.concat(F.lit("/"), _arg(0)), method=F.lit("GET"), auth_level=seen, callback=F.concat(F.lit("endpoint:"), _arg(0)), namespace=F.lit("rewrite")))
    bodies = callback_facts(facts) if bodies is None else bodies
    hooks = with_body(hook_calls(facts).where("hook in ('template_redirect', 'parse_request')"), bodies)
    level = F.when(F.col("hook") == "template_redirect", F.greatest(F.coalesce("body.level", F.lit(0)), F.when(F.col("body").isNull(), F.col("context_level")).otherwise(0))).otherwise(F.coalesce("body.level", F.lit(0)))
    plain = F.concat(F.lit("/"), F.translate("hook", "_", "-"), F.lit(":"), _clean(F.col("callback")))
    asked = F.when(F.col("body.first_field") != "", F.concat(F.lit("/?action="), F.col("body.first_field"))).when(F.col("body.query_var") != "", F.concat(F.lit("/"), F.col("body.query_var"))).otherwise(plain)
    found.append(_rows(hooks, "rest", route=asked, method=F.lit("GET"), auth_level=level, callback=_clean(F.col("callback")), namespace=F.col("hook")))
    found.append(content_types(facts))
    filt = with_body(hook_calls(facts).where("hook = 'xmlrpc_methods'"), bodies)
    keys = F.when(F.size("body.keys") > 0, F.col("body.keys")).otherwise(F.array(F.lit("custom")))
    found.append(_rows(filt.withColumn("m", F.explode(keys)), "rest", route=F.concat(F.lit("/xmlrpc.php:"), F.col("m")), method=F.lit("POST"), auth_level=F.coalesce("body.level", F.lit(0)), callback=_clean(F.col("callback")), namespace=F.lit("xmlrpc")))
    return reduce(DataFrame.unionByName, found)


def content_types(facts: Facts) -> DataFrame:
    """Post types and taxonomies shown in REST, times their fixed operations."""
    rows = facts.calls.where("callee in ('register_post_type', 'register_taxonomy') and size(args) >= 1")
    arg = F.when(F.col("callee") == "register_taxonomy", 2).otherwise(1)
    own = F.filter("items", lambda i: (i["arg"] == F.col("arg")) & (i["grp"] == -1))
    rows = rows.withColumn("arg", arg).withColumn("own", own)
    rows = rows.where(F.lower(_item(F.col("own"), F.lit(-1), "show_in_rest", "value")) == "true").withColumn("base", F.coalesce(_item(F.col("own"), F.lit(-1), "rest_base", "val"), _arg(0)))
    spark = rows.sparkSession
    ops = spark.createDataFrame([("register_post_type", *o) for o in W.POST_TYPE_OPS] + [("register_taxonomy", *o) for o in W.TAXONOMY_OPS], "callee string, suffix string, verb string, op_level int, op string")
    rows = rows.join(F.broadcast(ops), "callee")  # 7 rows
    return _rows(rows, "rest", route=F.concat(F.lit("/wp-json/wp/v2/"), F.col("base"), F.col("suffix")), method=F.col("verb"), auth_level=F.col("op_level"), callback=F.col("op"), namespace=F.lit("wp/v2"))


def wrappers(facts: Facts) -> DataFrame:
    """Functions that pass a parameter on as a hook's name: (plugin, class, method, index, prefix, kind)."""
    fns = facts.functions.where("not is_closure").select(*KEY, node_of().alias("holder"), F.col("name").alias("enclosing_fn"), F.col("class").alias("enclosing_class"), "params", "is_static")
    hook = facts.calls.where("callee in ('add_action', 'add_filter')").select(*KEY, "holders", _arg(0).alias("v"), F.lit("hook").alias("kind"), F.lit("").alias("ns"), F.lit(None).cast("string").alias("perm"))
    rest_ = facts.calls.where("callee = 'register_rest_route'").select(*KEY, "holders", _arg(1).alias("v"), F.lit("rest").alias("kind"), _arg(0).alias("ns"), _item(F.filter("items", lambda i: i["arg"] == 2), F.lit(-1), "permission_callback", "cb").alias("perm"))
    made = hook.unionByName(rest_).withColumn("holder", F.explode("holders")).join(fns, [*KEY, "holder"]).where("enclosing_fn not in ('register_routes', 'register_rest_route')")
    name = R.placeholder(R.clean_interpolation(F.col("v")))
    at = F.array_position("params", name)
    prefix = F.regexp_extract("v", r"^([^{$]*)", 1)
    return made.where((name != "") & (at > 0)).select("plugin_slug", F.col("enclosing_class").alias("class_name"), F.col("enclosing_fn").alias("method_name"), "is_static", (at - 1).cast("int").alias("param_index"), prefix.alias("prefix"), F.col("file").alias("source_file"), "kind", "ns", "params", "perm").distinct()


def wrapper_calls(facts: Facts, config: Config | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """Calls of wrappers, as the hooks and routes that they register."""
    own = wrappers(facts).withColumnRenamed("method_name", "callee")
    calls = facts.calls.join(own, ["plugin_slug", "callee"])
    same = (F.col("class_name") == "") == (F.col("receiver_kind") == "none")
    by_class = (F.col("receiver_kind") != "static") | F.lower(F.regexp_extract("receiver", r"([^\\]*)$", 1)).isin("self", "static", "parent") | (F.regexp_extract("receiver", r"([^\\]*)$", 1) == F.col("class_name"))
    calls = calls.where(same & by_class).withColumn("v", F.concat("prefix", F.coalesce(F.get("vals", F.col("param_index")), F.lit("")))).where("size(args) > param_index")
    cb = F.coalesce(F.get("callbacks", F.col("param_index") + 1), F.lit("callback"))
    hooks = calls.where("kind = 'hook'").where(R.starts_with_any(F.col("v"), [h[0] for h in W.AJAX_HOOKS if not h[0].startswith("woocommerce")]))
    found = _rows(hooks, "ajax", route=R.ajax_route(F.col("v")), method=F.lit("POST"), auth_level=F.when(F.contains("v", F.lit("nopriv_")), 0).otherwise(1), callback=_clean(cb))
    at = lambda word: F.array_position(F.transform("params", F.lower), word) - 1
    routes = calls.where("kind = 'rest'")
    method = F.coalesce(F.get("vals", F.coalesce(F.when(at("methods") >= 0, at("methods")), F.when(at("method") >= 0, at("method"))).cast("int")), F.lit("GET"))
    handler = F.coalesce(F.get("callbacks", F.when(at("callback") >= 0, at("callback")).cast("int")), F.lit("wrapper_callback"))
    bodies = (callback_facts(facts) if bodies is None else bodies).select("plugin_slug", F.col("file").alias("source_file"), "cb_name", F.col("body.level").alias("perm_level"), F.col("body.returns").alias("perm_returns"))
    routes = routes.withColumn("cb_name", F.element_at(F.split("perm", "::"), -1)).join(bodies, ["plugin_slug", "source_file", "cb_name"], "left")
    level = F.when((F.col("perm") == "__return_true") | (F.col("perm_returns") == 0), 0).otherwise(F.coalesce("perm_level", F.lit(W.SUBSCRIBER)))
    routes = routes.withColumn("verb1", F.explode(verbs(method))).withColumn("level", level)
    return found.unionByName(_rows(routes, "rest", route=R.rest_route(F.col("ns"), F.col("v")), method=F.col("verb1"), auth_level=F.col("level"), callback=_clean(handler), namespace=F.col("ns")))


def detect_all(facts: Facts, config: Config | None = None, compat: bool = False) -> DataFrame:
    """Union of all detectors; ``compat`` reproduces historical quirks where the intent is the default."""
    config = config or Config()
    bodies = graph._write(callback_facts(facts), "bodies")
    each = {
        "rest": lambda: rest(facts, config, bodies, compat),
        "ajax": lambda: ajax(facts, config, bodies, compat),
        "admin": lambda: admin_pages(facts, config, bodies, compat),
        "shortcodes": lambda: shortcodes(facts, bodies),
        "widgets": lambda: widgets(facts),
        "blocks": lambda: blocks(facts, bodies),
        "hooks": lambda: hook_input(facts, bodies),
        "direct": lambda: direct_files(facts),
        "framework": lambda: framework(facts, config, bodies),
        "wrappers": lambda: wrapper_calls(facts, config, bodies),
        "controllers": lambda: controllers(facts),
    }
    # the detectors are independent: planned and run at the same time, each written, so that what follows plans over tables
    found = together(facts.base.sparkSession, *[lambda name=name, rows=rows: graph._write(rows(), f"detected-{name}") for name, rows in each.items()])
    return reduce(DataFrame.unionByName, found)
