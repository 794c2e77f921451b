"""Scalar rules as Spark columns: levels, routes, names, formats. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from . import words as W


def contains_any(c: Column, words) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def starts_with_any(c: Column, words) -> Column:
    return c.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")") if words else F.lit(False)


def ends_with_any(c: Column, words) -> Column:
    return c.rlike("(?:" + "|".join(re.escape(w) for w in words) + ")$") if words else F.lit(False)


def is_permission_name(name: Column) -> Column:
    """Whether a function's name says that it checks a permission."""
    name = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return contains_any(name, W.PERMISSION_NAMES) | ends_with_any(name, W.PERMISSION_ENDS)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, W.LEVELS)), level.cast("int") + 1)


def level_value(name: Column) -> Column:
    out = F.when(name == "user", 1)
    for k, v in enumerate(W.LEVELS):
        out = out.when(name == v, k)
    return out.otherwise(0)


def install_bucket(n: Column) -> Column:
    out = F.when(n.isNull(), "Less than 10")
    for least, label in W.INSTALL_BUCKETS:
        out = out.when(n >= least, label)
    return out.otherwise("Less than 10")


def capability_level_by_name(cap: Column) -> Column:
    cap = F.lower(cap)
    admin = starts_with_any(cap, W.CAP_ADMIN_STARTS) | ends_with_any(cap, W.CAP_ADMIN_ENDS) | contains_any(cap, W.CAP_ADMIN_PARTS) | cap.isin(*W.CAP_ADMIN_NAMES)
    return F.when(admin, W.ADMIN).when(contains_any(cap, W.CAP_EDITOR_PARTS) | starts_with_any(cap, W.CAP_EDITOR_STARTS), W.EDITOR).otherwise(0)


def capability_level(cap: Column, config: Config | None = None) -> Column:
    """Level of a capability: configured, else by its name, else a subscriber's."""
    config = config or Config()
    out = F.when(F.lit(False), 0)
    for given in (config.custom, config.extended):
        for k, v in given.items():
            out = out.when(cap == k, W.LEVELS.index(v) if v in W.LEVELS else int(v == "user"))
    for level, caps in config.core:
        out = out.when(cap.isin(*caps), level)
    named = capability_level_by_name(cap)
    return out.when(named > 0, named).otherwise(W.SUBSCRIBER)


def is_user_facing(action: Column, config: Config) -> Column:
    return contains_any(action, config.user_facing)


def is_admin_action(action: Column, config: Config | None = None) -> Column:
    """Whether an action's name speaks of administration."""
    config = config or Config()
    name = F.replace(F.lower(action), F.lit("-"), F.lit("_"))
    user = is_user_facing(name, config)
    sure = starts_with_any(name, [*W.AJAX_ADMIN_PREFIXES, *config.ajax_admin_prefixes]) | contains_any(name, config.ajax_admin_keywords)
    return sure | ((contains_any(name, W.ACTION_EXTRA) | contains_any(name, W.ACTION_LIKELY_ADMIN)) & ~user)


def route_level(route: Column, namespace: Column, level: Column, public: Column, config: Config | None = None) -> Column:
    """Route heuristics over a declared level."""
    config = config or Config()
    full = F.lower(F.concat(namespace, F.lit("/"), route))
    low = level.isin(0, 1)
    likely = contains_any(full, W.ROUTE_LIKELY_ADMIN) & ~contains_any(full, W.ROUTE_USER_FACING)
    own = contains_any(F.lower(namespace), [n.lower() for n in config.rest_admin_namespaces])
    return (
        F.when(public, 0)
        .when(own, F.when(low, W.ADMIN).otherwise(level))
        .when(F.contains(namespace, F.lit("{")) & (level == 1) & likely, W.ADMIN)
        .when(contains_any(full, config.rest_public), 0)
        .when(contains_any(full, config.rest_user), F.when(level == 0, 1).otherwise(level))
        .when(low & (contains_any(full, config.rest_admin) | F.contains(full, F.lit("/admin"))), W.ADMIN)
        .when((level == 1) & likely, W.ADMIN)
        .otherwise(level)
    )


def clean_interpolation(s: Column) -> Column:
    """PHP interpolation in a route as ``{name}``."""
    s = F.regexp_replace(s, r"\{\$this->(\w+)\}", "{$1}")
    s = F.regexp_replace(s, r"\{\$(\w+)[^}]*\}", "{$1}")
    s = F.regexp_replace(s, r"\$\{(\w+)\}", "{$1}")
    return F.regexp_replace(s, r"\$this->(\w+)|\$([A-Za-z_]\w*)", "{$1$2}")


def rest_route(namespace: Column, route: Column) -> Column:
    """/wp-json/<namespace>/<route> without doubled slashes."""
    ns = F.regexp_replace(namespace, "^/+|/+$", "")
    joined = F.concat(F.lit("/wp-json/"), ns, F.when(route.startswith("/"), route).otherwise(F.concat(F.lit("/"), route)))
    return clean_interpolation(F.when(F.contains(joined, F.lit("://")), joined).otherwise(F.regexp_replace(joined, "/{2,}", "/")))


def admin_route(slug: Column) -> Column:
    slug = clean_interpolation(slug)
    return F.when(slug == "", "").when(slug.startswith("wp-admin/") | slug.startswith("{"), slug).otherwise(F.concat(F.lit("wp-admin/admin.php?page="), slug))


def ajax_route(hook: Column) -> Column:
    """Route of a hook name by its prefix; other names stay."""
    out = F.when(hook.startswith("elementor_ajax:"), F.concat(F.lit("wp-admin/admin-ajax.php?action=elementor_ajax&actions="), F.regexp_replace(hook, "^elementor_ajax:", "")))
    out = out.when(hook.startswith("acf_ajax:"), F.concat(F.lit("wp-admin/admin-ajax.php?action=acf/"), F.regexp_replace(hook, "^acf_ajax:", "")))
    out = out.when(hook.startswith("direct_ajax_"), F.concat(F.lit("wp-admin/admin-ajax.php?action="), F.regexp_replace(hook, "^direct_ajax_", "")))
    for prefix, url, *_ in W.AJAX_HOOKS:
        out = out.when(hook.startswith(prefix), F.concat(F.lit(url), F.regexp_replace(hook, f"^{prefix}", "")))
    return out.otherwise(hook)


def rewrite_path(pattern: Column) -> Column:
    """Path of a rewrite rule: anchors gone, groups numbered as ``{paramN}``."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"^\^", ""), r"\$$", ""), r"/\?$", ""), "/$", "")
    parts = F.split(bare, r"\([^)]+\)")
    named = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("{param"), i.cast("string"), F.lit("}"), p))), "")
    return F.when(named.startswith("/"), named).otherwise(F.concat(F.lit("/"), named))


def query_callback(query: Column) -> Column:
    page, own = F.regexp_extract(query, r"(?:pagename|page)=([^&]+)", 1), F.regexp_extract(query, "([a-z_]+)=", 1)
    return F.when(page != "", F.concat(F.lit("page:"), page)).when(own != "", F.concat(F.lit("query:"), own)).otherwise(query)


def collapse(code: Column, most: int = 500) -> Column:
    """White space, Unicode's too, as single spaces; cut to ``most`` bytes, a character that does not fit left out."""
    flat = F.trim(F.regexp_replace(code, r"(?U)\s+", " "))
    data = flat.cast("binary")
    # bytes past the cut that continue a character belong to one that does not fit
    back = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(-1), lambda acc, k: F.when((acc < 0) & (F.hex(F.substring(data, most + 1 - k, F.lit(1))).rlike("^[89AB]") == F.lit(False)), k).otherwise(acc))
    return F.when(F.octet_length(flat) > most, F.concat(F.substring(data, F.lit(1), most - F.greatest(back, F.lit(0))).cast("string"), F.lit("..."))).otherwise(flat)


def is_placeholder(route: Column) -> Column:
    return route.rlike(r"\{[^}]+\}")


def placeholder(route: Column) -> Column:
    return F.regexp_extract(route, r"\{([^}]+)\}", 1)


def line_of(text: Column, offset: Column) -> Column:
    """1 + newlines before a 0-based offset."""
    left = F.substring(text, F.lit(1), offset)
    return F.length(left) - F.length(F.replace(left, F.lit("\n"), F.lit(""))) + 1


def gap_reason(before: Column, raw: Column) -> Column:
    head = F.substring(raw, 1, 100)
    dollars = F.length(head) - F.length(F.replace(head, F.lit("$"), F.lit("")))
    return F.when(F.contains(before, F.lit("function")) & F.contains(before, F.lit("use")), "wrapper_pattern").when(dollars >= 3, "dynamic_args").otherwise("complex_expression")


def normal_route(route: Column) -> Column:
    """A route for comparison with manual truth."""
    r = F.lower(route)
    for pattern in ("^/", "^wp-json/", "^wp-admin/"):
        r = F.regexp_replace(r, pattern, "")
    for word in ("wp_ajax_", "admin-ajax.php?action=", "admin.php?page="):
        r = F.replace(r, F.lit(word), F.lit(""))
    for pattern, to in ((r"\(\?[pP]<[^>]+>", "("), (r"\(\?P<[^>]+>[^)]+\)", "*"), (r"\{[^}]+\}", "*"), (r"\\d\+", "*"), (r"\[[^\]]+\]\+?", "*"), (r"\(\*\)", "*"), (r"\*+", "*"), ("/$", "")):
        r = F.regexp_replace(r, pattern, to)
    return r


def route_key(route: Column) -> Column:
    parts = F.filter(F.split(normal_route(route), "/"), lambda p: (p != "") & (p != "*") & (F.length(p) > 1))
    return F.array_join(parts, "/")


def fuzzy_score(a: Column, b: Column) -> Column:
    """Likeness of two route keys, 0 to 1."""
    # The scores, and the lengths from which they hold. ``report.match_manual`` finds the same pairs by index.
    pa, pb = F.split(a, "/"), F.split(b, "/")
    la, lb = F.element_at(pa, -1), F.element_at(pb, -1)
    same = F.aggregate(F.transform(pa, lambda x: F.size(F.filter(pb, lambda y: (y == x) & (F.length(y) > 2)))), F.lit(0), lambda s, x: s + x)
    return (
        F.when((a == b) & (a != ""), 1.0)
        .when((F.contains(a, b) | F.contains(b, a)) & (F.length(a) > 3) & (F.length(b) > 3), 0.8)
        .when((la == lb) & (F.length(la) > 3), 0.7)
        .when((F.contains(la, lb) | F.contains(lb, la)) & ((F.length(la) > 5) | (F.length(lb) > 5)), 0.6)
        .when(same >= 2, 0.6)
        .when((same >= 1) & ((F.size(pa) <= 2) | (F.size(pb) <= 2)), 0.5)
        .otherwise(0.0)
    )
