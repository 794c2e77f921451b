"""Report sinks: text, call trees, JSON. Texts stream over partitions in order of level."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W

RULE = "=" * 60
ORDER = ["auth_level", "plugin_slug", "route", "method", "type", "file", "line"]
HIDDEN = ("", "unknown", "array_defined")
_LABEL = {"ajax": "AJAX ", "admin": "ADMIN ", "shortcode": "SHORTCODE ", "widget": "WIDGET ", "block": "BLOCK ", "hook_input": "HOOK "}
_TITLE = {6: "SUPER ADMIN"}


def _head(r: dict) -> str:
    return f"{r['method'] or 'GET'} {r['route']}" if r["type"] == "rest" else f"{_LABEL.get(r['type'], '')}{r['route']}"


def _sections(endpoints: DataFrame) -> Iterator[tuple[list[str], dict]]:
    """Rows in order, with the lines of a section's title before its first row."""
    counts = {r["auth_level"]: r["count"] for r in endpoints.groupBy("auth_level").count().collect()}  # 7 rows at most
    last = None
    for row in endpoints.orderBy(*ORDER).toLocalIterator():
        lead: list[str] = []
        if row["auth_level"] != last:
            last = row["auth_level"]
            lead = ["", RULE, f"{_TITLE.get(last, W.LEVELS[last].upper())} ENDPOINTS ({counts[last]})", RULE]
        yield lead, row.asDict()


def head_column() -> Column:
    """Verb and route of a REST endpoint, else the type's label and the route."""
    label = F.lit("")
    for kind, text in _LABEL.items():
        label = F.when(F.col("type") == kind, text).otherwise(label)
    verb = F.when(F.coalesce("method", F.lit("")) == "", "GET").otherwise(F.col("method"))
    return F.when(F.col("type") == "rest", F.concat(verb, F.lit(" "), "route")).otherwise(F.concat(label, "route"))


def line_column(endpoints: DataFrame) -> Column:
    """An endpoint's line: head, callback, input fields of shortcodes, and what it calls."""
    line = F.concat(head_column(), F.when(F.col("callback").isin(*HIDDEN), "").otherwise(F.concat(F.lit(" -> "), "callback")))
    line = F.concat(line, F.when((F.col("type") == "shortcode") & (F.col("raw_code") != ""), F.concat(F.lit(" "), "raw_code")).otherwise(""))
    if "function_calls" in endpoints.columns:
        line = F.concat(line, F.when(F.size("function_calls") > 0, F.concat(F.lit(" ["), F.array_join("function_calls", ", "), F.lit("]"))).otherwise(""))
    return line


def text_lines(endpoints: DataFrame) -> DataFrame:
    """(auth_level, kind, text) of the report in order: a section's title (kind 0), then its endpoints (kind 1)."""
    title = F.lit("")
    for k, name in enumerate(W.LEVELS):
        title = F.when(F.col("auth_level") == k, _TITLE.get(k, name.upper())).otherwise(title)
    counts = endpoints.groupBy("auth_level").agg(F.count("*").alias("n"))
    heads = counts.select("auth_level", F.lit(0).alias("kind"), F.concat(title, F.lit(" ENDPOINTS ("), "n", F.lit(")")).alias("text"), *[F.lit(None).alias(c) for c in ORDER[1:]])
    rows = endpoints.select("auth_level", F.lit(1).alias("kind"), line_column(endpoints).alias("text"), *ORDER[1:])
    return heads.unionByName(rows).orderBy("auth_level", "kind", *ORDER[1:]).select("auth_level", "kind", "text")


def write_text(endpoints: DataFrame, path: str) -> None:
    """The report's lines as text files, in order over files."""
    text_lines(endpoints).select("text").write.text(path)


def text_report(endpoints: DataFrame) -> Iterator[str]:
    """One line an endpoint, in sections by level."""
    for r in text_lines(endpoints).toLocalIterator():
        yield from [r["text"]] if r["kind"] else ["", RULE, r["text"], RULE]


def _tree(paths: list[list[str]]) -> dict:
    tree: dict = {}
    for p in paths:
        at = tree
        for x in p:
            at = at.setdefault(x, {})
    return tree


def render_tree(paths: list[list[str]], lead: str) -> list[str]:
    """Box drawing of call paths."""

    def draw(node: dict, lead: str) -> list[str]:
        out = []
        for k, (name, below) in enumerate(node.items()):
            end = k == len(node) - 1
            out.append(f"{lead}{'└── ' if end else '├── '}{name}")
            out += draw(below, lead + ("    " if end else "│   "))
        return out

    return draw(_tree(paths), lead)


def nested(paths: list[list[str]]) -> list[dict]:
    """Call paths as nested nodes."""

    def node(name: str, below: dict) -> dict:
        return {"function": name} | ({"calls": [node(*x) for x in below.items()]} if below else {})

    return [node(*x) for x in _tree(paths).items()]


def tree_column(paths: Column, lead: str = "") -> Column:
    """Box drawing of the call paths of each row, a line a node."""

    @F.pandas_udf("string")
    def draw(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: "" if x is None else "\n".join(render_tree([list(p) for p in x], lead)))

    return draw(paths)


def chain_column(paths: Column) -> Column:
    """Call paths of each row as JSON of nested nodes."""

    @F.pandas_udf("string")
    def chain(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: json.dumps(nested([] if x is None else [list(p) for p in x]), ensure_ascii=False))

    return chain(paths)


def chain_report(endpoints: DataFrame) -> Iterator[str]:
    """Endpoints with ``paths`` as call trees."""
    for lead, r in _sections(endpoints):
        yield from [*lead, "", _head(r)]
        if r["callback"] not in HIDDEN:
            yield f"  Callback: {r['callback']}"
        if r["raw_code"] and r["type"] == "shortcode":
            yield f"  Input Fields: {r['raw_code']}"
        if r["paths"]:
            yield "  Call Chain:"
            yield from render_tree(r["paths"], "    ")


def chain_json(endpoints: DataFrame) -> Iterator[str]:
    """A JSON array of endpoints with nested call chains, an object a line."""
    first = True
    yield "["
    for _, r in _sections(endpoints):
        row = {"plugin_slug": r["plugin_slug"], "method": r["method"], "route": r["route"], "type": r["type"], "auth_level": W.LEVELS[r["auth_level"]], "callback": r["callback"], "file": r["file"], "line": r["line"], "call_chain": nested(r["paths"] or [])}
        text = json.dumps({k: v for k, v in row.items() if k not in ("method", "call_chain") or v}, ensure_ascii=False)
        yield ("" if first else ",") + text
        first = False
    yield "]"


def summary_text(s: dict) -> str:
    lines = ["", RULE, "SUMMARY", RULE, f"Total: {s['total_endpoints']} endpoints", f"  Unauthenticated: {s['unauthenticated_count']}"]
    lines.append(f"  Authenticated:   {s['authenticated_count']} ({', '.join(f'{n}: {s[f'{n}_count']}' for n in W.LEVELS[1:])})")
    lines.append(f"Types: {s['rest_count']} REST | {s['ajax_count']} AJAX | {s['admin_pages_count']} Admin | {s['shortcode_count']} Shortcode | {s['widget_count']} Widget | {s['block_count']} Block | {s['hook_input_count']} Hook")
    if s["total_plugins"] > 1:
        lines.append(f"Plugins: {s['total_plugins']}")
    return "\n".join(lines)


def _document(sections: list[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """(section, nth, text) of a JSON document in order: each section's opening text, its elements with commas between, its closing text.

    An element frame has ``key`` (its order, unlike any other's) and ``text``; only its least key is looked up to know the first.
    """
    out = None
    for n, (opening, closing, rows) in enumerate(sections):
        spark = next(r for _, _, r in sections if r is not None).sparkSession
        parts = spark.createDataFrame([(n, 0, "", opening), (n, 2, "", closing)], "section int, kind int, key string, text string")
        if rows is not None:
            least = rows.agg(F.min("key").alias("least"))
            own = rows.join(F.broadcast(least)).select(F.lit(n).alias("section"), F.lit(1).alias("kind"), "key", F.concat(F.when(F.col("key") == F.col("least"), "").otherwise(","), "text").alias("text"))  # one row
            parts = parts.unionByName(own)
        out = parts if out is None else out.unionByName(parts)
    return out.where("text <> ''").orderBy("section", "kind", "key").select("section", "kind", "text")


def _key(*cols: str) -> Column:
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def full_report_lines(endpoints: DataFrame, plugins: DataFrame, summary: DataFrame) -> DataFrame:
    """The full report as ordered lines (section, kind, text): plugins (section 0), endpoints by level (1 to 7), the summary (8)."""
    level = F.element_at(F.array(*map(F.lit, W.LEVELS)), F.col("auth_level") + 1)
    body = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in endpoints.dtypes if c != "auth_level"]
    rows = endpoints.select("auth_level", _key(*ORDER[1:], *[c for c in endpoints.columns if c not in ORDER]).alias("key"), F.to_json(F.struct(*body, level.alias("auth_level"))).alias("text"))
    sections = [('{"plugins": [', '], "endpoints": {', plugins.select(_key("plugin_slug").alias("key"), F.to_json(F.struct(*plugins.columns)).alias("text")))]
    for k, name in enumerate(W.LEVELS):
        sections.append((f'{"," if k else ""}"{name}": [', "]", rows.where(F.col("auth_level") == k).select("key", "text")))
    return _document([*sections, ('}, "summary": ', "}", summary.drop("authenticated_count").select(F.lit("").alias("key"), F.to_json(F.struct("*")).alias("text")))])


def write_lines(lines: DataFrame, path: str) -> None:
    """A document's lines as text files, in order over files."""
    lines.select("text").write.text(path)


def full_report(done) -> Iterator[str]:
    """The full report's lines, one after another."""
    return (r["text"] for r in full_report_lines(done.endpoints, done.plugins, done.summary()).toLocalIterator())


def reachability_lines(verified: DataFrame) -> DataFrame:
    """Verified targets as ordered lines of a JSON document: the summary (section 0), then the results (1)."""
    counts = verified.agg(F.count("*").alias("total"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("not_reachable"), F.count_if("direct_match").alias("endpoints_found"))
    rows = verified.withColumn("n", F.monotonically_increasing_id())
    rows = rows.select(F.concat(_key("plugin_slug", "relative_path"), F.lpad(F.col("n").cast("string"), 20, "0")).alias("key"), F.to_json(F.struct(*verified.columns)).alias("text"))
    return _document([('{"summary": ', "", counts.select(F.lit("").alias("key"), F.to_json(F.struct("*")).alias("text"))), (', "results": [', "]}", rows)])


def plugin_lines(plugins: DataFrame) -> DataFrame:
    """(plugin_slug, line): slug, name (cut at 38 characters) and version of plugins."""
    name = F.when(F.length("name") > 38, F.concat(F.substring("name", 1, 35), F.lit("..."))).otherwise(F.col("name"))
    wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    return plugins.select("plugin_slug", F.concat_ws(" ", wide(F.col("plugin_slug"), 40), wide(name, 38), "version").alias("line"))


def plugin_list(plugins: DataFrame) -> Iterator[str]:
    return (r["line"] for r in plugin_lines(plugins).orderBy("plugin_slug").toLocalIterator())


def validation_text(metrics: DataFrame, missed: DataFrame, worst: DataFrame, accuracy: DataFrame) -> Iterator[str]:
    """Coverage by type, level accuracy, most missed patterns, worst plugins."""
    yield "COVERAGE"
    for r in metrics.orderBy("type").toLocalIterator():
        yield f"{r['type']:<20} {r['total']:>10} {r['detected']:>10} {r['coverage']:>9.1f}%"
    a = accuracy.first()
    yield f"Auth accuracy: {a['accuracy']:.1f}% ({a['correct']} correct, {a['wrong']} wrong)"
    yield "TOP MISSED PATTERNS"
    for r in missed.toLocalIterator():
        yield f"{r['n']:>6} {r['type']} {r['pattern']}"
    yield "WORST PLUGINS"
    for r in worst.toLocalIterator():
        yield f"{r['coverage']:>9.1f}% {r['plugin_slug']} ({r['found']}/{r['total']})"
