"""Readers of PHP corpora, listings, plugin information and tool inputs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import words as W

FILE_SCHEMA = "plugin_slug string, file string, content binary"
# Directories that each scan skips, beside what the configuration names.
PRUNE = {
    "analysis": None,
    "wrappers": ["vendor", "node_modules", ".git"],
    "ast": ["vendor", "node_modules"],
    "direct": ["templates", "views", "partials", "vendor", "node_modules"],
    "reachability": [".git", "node_modules"],
}


def read_corpus(spark: SparkSession, root: str, single: bool = False) -> DataFrame:
    """All files below ``root`` as (plugin_slug, file, content); without ``single`` each sub-directory is a plugin."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").rpartition("://")[2].lstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), f"^/*{base}/", "")
    rows = rows.select(rel.alias("rel"), "content")
    if single:
        return rows.select(F.lit(root.rstrip("/").rpartition("/")[2]).alias("plugin_slug"), F.col("rel").alias("file"), "content")
    return rows.where(F.contains("rel", F.lit("/"))).select(F.element_at(F.split("rel", "/"), 1).alias("plugin_slug"), F.expr("substring(rel, instr(rel, '/') + 1)").alias("file"), "content")


def php_files(files: DataFrame, config: Config | None = None, scan: str = "analysis") -> DataFrame:
    """PHP files of a scan: suffix without case, directories pruned by name, and below composer.json if so configured."""
    config = config or Config()
    pruned = PRUNE[scan] if PRUNE[scan] is not None else list(config.vendor_dirs)
    dirs = F.slice(F.split("file", "/"), 1, F.greatest(F.size(F.split("file", "/")) - 1, F.lit(0)))
    if scan == "ast":
        dirs = F.transform(dirs, F.lower)
    out = files.where(F.lower("file").endswith(".php") & ~F.arrays_overlap(dirs, F.array(*map(F.lit, pruned))))
    if scan == "analysis" and config.skip_composer_dirs:
        composer = files.where(F.col("file").rlike(r".+/composer\.json$")).select("plugin_slug", F.regexp_replace("file", r"/composer\.json$", "").alias("dir")).distinct()
        above = F.transform(F.sequence(F.lit(1), F.size("__dirs")), lambda k: F.array_join(F.slice("__dirs", 1, k), "/"))
        nested = out.withColumn("__dirs", dirs).where(F.size("__dirs") > 0).select("plugin_slug", "file", F.explode(above).alias("dir")).join(composer, ["plugin_slug", "dir"], "left_semi").select("plugin_slug", "file").distinct()
        out = out.join(nested, ["plugin_slug", "file"], "left_anti")
    return out


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 512 bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 512)) > 0


def without_bom(content: Column) -> Column:
    return F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.length(content))).otherwise(content)


def is_single_plugin(files: DataFrame) -> DataFrame:
    """One row: whether any PHP file at the root holds a plugin header."""
    root = files.where(~F.contains("file", F.lit("/")) & F.lower("file").endswith(".php"))
    return root.agg(F.coalesce(F.bool_or(F.contains(F.col("content").cast("string"), F.lit("Plugin Name:"))), F.lit(False)).alias("single"))


def plugin_headers(files: DataFrame) -> DataFrame:
    """(plugin_slug, name, version) of the main file: <slug>.php, else the first root file."""
    root = files.where(~F.contains("file", F.lit("/")) & F.col("file").endswith(".php"))
    main = root.groupBy("plugin_slug").agg(F.min_by(F.col("content").cast("string"), F.struct(F.col("file") != F.concat("plugin_slug", F.lit(".php")), "file")).alias("text"))
    line = lambda key: F.trim(F.regexp_extract("text", rf"(?m)^\s*(?:\*|//)\s*{key}:[ \t]*(.*?)[ \t]*(?:\*/)?\r?$", 1))
    return main.select("plugin_slug", line("Plugin Name").alias("name"), line("Version").alias("version"))


def unzip(zips: DataFrame) -> DataFrame:
    """Rows of ZIP archives (plugin_slug, content) as corpus files; entries that leave the archive are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for slug, data in zip(pdf["plugin_slug"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for info in z.infolist():
                            name = info.filename.replace("\\", "/")
                            if info.is_dir() or name.startswith("/") or ".." in name.split("/"):
                                continue
                            parts = name.split("/", 1)
                            out.append((slug, parts[-1], z.read(info)))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["plugin_slug", "file", "content"])

    return zips.select("plugin_slug", "content").mapInPandas(run, FILE_SCHEMA)


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, href) of anchors in order."""
    hrefs = F.regexp_extract_all(html_col, F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), 1)
    return pages.select(id_col, F.posexplode(hrefs).alias("pos", "href"))


def plugin_slugs(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Plugin slugs of a listing page in order of first occurrence."""
    slug = F.regexp_extract("href", r"/plugins/([^/]+)/?$", 1)
    found = links(pages, id_col, html_col).withColumn("slug", slug).where((F.col("slug") != "") & ~F.col("slug").isin(W.RESERVED_SLUGS))
    return found.groupBy(id_col, "slug").agg(F.min("pos").alias("pos"))


def popular(pages: DataFrame, max_pages: int = 0, max_plugins: int = 0) -> DataFrame:
    """(slug, pos) of a listing's pages (page, html) in order of first occurrence, up to a number of pages and of plugins (0: all).

    The first page's pagination says how many pages there are.
    """
    if max_pages < 0 or max_plugins < 0:
        raise ValueError("bounds must not be negative")
    last = page_count(pages.where("page = 1"), "page", "html").select(F.col("pages").alias("last"))
    kept = pages.join(F.broadcast(last)).where("page <= last")  # one row
    kept = kept.where(F.col("page") <= max_pages) if max_pages else kept
    first = plugin_slugs(kept, "page", "html").groupBy("slug").agg(F.min(F.struct("page", "pos")).alias("at"))
    ranked = first.orderBy("at").limit(max_plugins) if max_plugins else first
    # slugs of earlier pages, then earlier ones of the page: two sums instead of one window over all
    by_page = ranked.groupBy("at.page").agg(F.count("*").alias("n"))
    before = by_page.select("page", F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a page
    own = ranked.select("slug", "at.page", F.row_number().over(Window.partitionBy("at.page").orderBy("at")).alias("nth"))
    return own.join(before, "page").select("slug", (F.col("before") + F.col("nth") - 1).cast("int").alias("pos"))


def page_count(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Largest page number among pagination links, 1 at least."""
    numbers = F.transform(F.regexp_extract_all(html_col, F.lit(r"/page/([0-9]+)"), 1), lambda x: x.cast("int"))
    return pages.select(id_col, F.greatest(F.coalesce(F.array_max(numbers), F.lit(1)), F.lit(1)).alias("pages"))


INFO = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "slug", "version", "author", "author_profile", "requires", "tested", "requires_php", "last_updated", "added", "homepage", "short_description", "download_link")] + [T.StructField(n, T.LongType()) for n in ("rating", "num_ratings", "active_installs", "downloaded")])


def flex_string(json_col: str, field: str) -> Column:
    """A string, or '' where the field is a bool, null, absent or anything else."""
    raw = F.get_json_object(F.col(json_col), f"$.{field}")
    typed = F.variant_get(F.try_parse_json(F.col(json_col)), f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_parse_json(F.to_json(F.struct(F.variant_get(F.try_parse_json(F.col(json_col)), f"$.{field}", "variant").alias("x")))))
    return F.coalesce(F.when(F.contains(kind, F.lit("STRING")), F.coalesce(typed, raw)), F.lit(""))


def flex_map(json_col: str, field: str) -> Column:
    """A string map; an array or anything else is the empty map, null is null."""
    raw = F.get_json_object(F.col(json_col), f"$.{field}")
    return F.when(raw.isNull(), None).when(raw.startswith("{"), F.from_json(raw, T.MapType(T.StringType(), T.StringType()))).otherwise(F.create_map().cast("map<string,string>"))


def plugin_info(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Plugin information of API responses, one row each."""
    info = rows.withColumn("__i", F.from_json(json_col, INFO))
    text = {f.name: flex_string(json_col, f.name) for f in INFO if isinstance(f.dataType, T.StringType)}
    number = {f.name: F.coalesce(F.col(f"__i.{f.name}"), F.lit(0)) for f in INFO if isinstance(f.dataType, T.LongType)}
    return info.select(*[c.alias(n) for n, c in {**text, **number}.items()], flex_map(json_col, "tags").alias("tags"), flex_map(json_col, "sections").alias("sections"))


def first_successes(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in rank order that succeeded; failures are replaced by later rows."""
    if n < 0:
        raise ValueError("the limit is negative")
    return rows.where("success").orderBy("rank").limit(n)


def targets_tsv(spark: SparkSession, path: str, marker: str = "plugins") -> DataFrame:
    """Reachability targets: tab-separated, header skipped, 9 columns at least, status FOUND."""
    lines = spark.read.text(path).withColumn("c", F.split("value", "\t"))
    at = F.array_position(F.split(F.col("c")[1], "/"), marker).cast("int")
    rows = lines.where((F.size("c") >= 9) & (F.col("c")[0] == "FOUND"))
    return rows.select(F.col("c")[1].alias("full_path"), F.col("c")[2].alias("plugin"), F.col("c")[3].alias("version"), F.col("c")[4].alias("relative_path"), F.col("c")[5].alias("cve"), F.when(at > 0, F.try_element_at(F.split(F.col("c")[1], "/"), at + 1)).alias("plugin_dir"))


def manual_truth(lines: DataFrame) -> DataFrame:
    """Labelled lines (file, line_no, value): section headers set the level of the lines below them."""
    from pyspark.sql import Window

    level = F.lower(F.regexp_extract("value", r"(?i)^\W*(unauthenticated|subscriber|contributor|author|editor|admin|superadmin)\W*(?:endpoints?)?\W*$", 1))
    level = F.when(level != "", level)
    over = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("header", level).withColumn("level", F.last("header", True).over(over))
    kind = F.when(F.contains("value", F.lit("wp-json")), "rest").when(F.contains("value", F.lit("admin-ajax")) | F.contains("value", F.lit("wp_ajax_")), "ajax").when(F.contains("value", F.lit("admin.php")), "admin").when(F.col("value").rlike(r"^\s*\["), "shortcode").otherwise("other")
    return rows.where("header is null and level is not null and trim(value) <> ''").select("file", "line_no", "level", F.trim("value").alias("route"), kind.alias("type"))
