"""Document fingerprints with DataFrame functions only: Merkle trees over sections and paragraphs.

A section is what a blank line ends, a paragraph a line with the line breaks after it. A paragraph's
digest is the SHA-256 of its text, a section's that of its paragraphs' digests, the root's that of its
sections' digests: equal roots are equal texts, and where roots differ, the branches that differ locate the
edit (``edited_span``). Below a paragraph, runs of up to ``WORDS`` words are kept as 64-bit marks, so
that texts of one long paragraph compare, too: ``likeness`` is Dice's measure over the distinct marks and the
root, which is 1 for equal texts alone.

``with_next`` pairs every row with the one after it in order of id (after the last: the first) with one
shuffle of the texts: ids are cut into ranges by their percentiles, a window in each range gives the next
row, and the first row of each range is lent to the range before it. Ranges number at most ``RANGES``; an
id that fills several of them is split by the digest of its texts.

Edge cases: a null text is an empty one: one section, one paragraph, no marks. Ties of ids are ordered by the
texts' SHA-256; null ids come last; repeated rows are rows of their own, in no order among each other.
A single row is followed by itself. Very long texts are one row's work; a word of over 64 characters counts
as several. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 4
RANGES = 20_000
_STEP = 128
SECTION = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
_SPACE = r"[ \t\n\x0B\f\r]"
MARK = rf"(?:{_SPACE}*[^ \t\n\x0B\f\r]{{1,64}}){{1,{WORDS}}}{_SPACE}*|{_SPACE}+"


def tree(text: Column) -> Column:
    """Sections of a text: array<struct<digest, paragraphs: array<struct<digest, chars>>>>."""

    def paragraphs(section: Column) -> Column:
        own = F.filter(F.regexp_extract_all(section, F.lit(PARAGRAPH), 0), lambda p: p != "")
        return F.transform(own, lambda p: F.struct(F.sha2(p, 256).alias("digest"), F.length(p).alias("chars")))

    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SECTION), paragraphs)
    return F.transform(parts, lambda p: F.struct(F.sha2(F.array_join(p["digest"], ""), 256).alias("digest"), p.alias("paragraphs")))


def root(sections: Column) -> Column:
    """Root digest of a tree's sections."""
    return F.sha2(F.array_join(sections["digest"], ""), 256)


def marks(text: Column) -> Column:
    """Distinct 64-bit marks of the runs of up to ``WORDS`` words; runs end with their paragraph."""
    paragraphs = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), 0), lambda p: p != "")
    runs = F.flatten(F.transform(paragraphs, lambda p: F.filter(F.regexp_extract_all(p, F.lit(MARK), 0), lambda r: r != "")))
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def likeness(root_a: Column, marks_a: Column, root_b: Column, marks_b: Column) -> Column:
    """Dice's measure over marks and root: 1 for equal roots alone, 0 where nothing is shared."""
    return F.when(root_a == root_b, 1.0).otherwise(2.0 * F.size(F.array_intersect(marks_a, marks_b)) / (F.size(marks_a) + F.size(marks_b) + 2))


def _equal_run(a: Column, b: Column, back: bool) -> Column:
    """How many digests are equal at the front (or the back) of two arrays of nodes."""
    n = F.least(F.size(a), F.size(b))
    at = lambda x, i: F.get(x, F.size(x) - i if back else i - 1)["digest"]
    equal = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: at(a, i) == at(b, i))).otherwise(F.array().cast("array<boolean>"))
    return (F.array_position(F.concat(equal, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def _paragraphs(sections: Column, i: Column) -> Column:
    return F.coalesce(F.get(sections, i)["paragraphs"], F.array().cast("array<struct<digest:string,chars:int>>"))


def _chars(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda acc, p: acc + p["chars"])


def _first(nodes: Column, n: Column) -> Column:
    return F.slice(nodes, F.lit(1), n)


def _last(nodes: Column, n: Column) -> Column:
    return F.slice(nodes, F.greatest(F.size(nodes) - n + 1, F.lit(1)), n)


def edited_span(a: Column, b: Column) -> Column:
    """struct<start, end>: the characters of tree a's text from the first differing paragraph to the last; null for equal trees.

    Sections are compared first, and paragraphs only in the first and the last section that differ.
    """
    total = lambda sections: F.aggregate(sections, F.lit(0).cast("long"), lambda acc, s: acc + _chars(s["paragraphs"]))
    front, back = _equal_run(a, b, False), _equal_run(a, b, True)
    head = lambda x: _paragraphs(x, front)
    tail = lambda x: _paragraphs(x, F.size(x) - 1 - back)
    start = total(_first(a, front)) + _chars(_first(head(a), _equal_run(head(a), head(b), False)))
    end = total(a) - total(_last(a, back)) - _chars(_last(tail(a), _equal_run(tail(a), tail(b), True)))
    return F.when(root(a) != root(b), F.struct(start.alias("start"), F.greatest(start, end).alias("end")))


def _range_of(key: Column, cuts: list[int], digest: Column) -> Column:
    """Number of the range that a key lies in; a key that makes up several cuts is spread over its ranges by its digest."""
    if not cuts:
        return F.lit(0)
    low = F.array(*map(F.lit, cuts))
    coarse = F.array(*map(F.lit, cuts[_STEP - 1 :: _STEP])) if len(cuts) >= _STEP else None

    def below(test) -> Column:
        if coarse is None:
            return F.size(F.filter(low, test))
        c = F.size(F.filter(coarse, test))
        return c * _STEP + F.size(F.filter(F.slice(low, c * _STEP + 1, _STEP), test))

    first, last = below(lambda x: x < key), below(lambda x: x <= key)
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(last - first < 2, first).otherwise(first + F.floor(part * (last - first + 1)).cast("int"))


def with_next(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sections, marks) of every row, with ``next``: struct<text, root, marks> of the row after it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(2**63 - 1)), "none": F.col("id").isNull(), "sha": F.sha2("text", 256)})
    n = ranges or min(RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] if n > 1 else []
    rows = rows.withColumn("range", _range_of(F.col("key"), sorted(cuts or []), F.col("sha")))
    first = rows.groupBy("range").agg(F.min(F.struct("key", "none", "sha")).alias("first"))
    over = Window.orderBy("range")  # one row a range
    lent = first.select("range", "first.*", F.coalesce(F.lag("range").over(over), F.max("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("into"))
    ghosts = rows.join(F.broadcast(lent), ["range", "key", "none", "sha"]).groupBy("into").agg(F.any_value("text").alias("text"))
    both = rows.select("range", "id", "text", "key", "none", "sha", F.lit(False).alias("ghost")).unionByName(ghosts.select(F.col("into").alias("range"), F.lit(None).cast("long").alias("id"), "text", F.lit(2**63 - 1).alias("key"), F.lit(True).alias("none"), F.lit("").alias("sha"), F.lit(True).alias("ghost")))
    dealt = both.repartition("range")
    dealt = dealt.withColumns({"sections": tree(F.col("text")), "marks": marks(F.col("text"))})
    dealt = dealt.withColumn("root", root(F.col("sections")))
    following = F.lead(F.struct("text", "root", "marks")).over(Window.partitionBy("range").orderBy("ghost", "key", "none", "sha"))
    return dealt.withColumn("next", following).where(~F.col("ghost")).select("id", "text", "sections", "root", "marks", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its text with the last quarter replaced by the next row's beginning, and their likeness."""
    rows = with_next(docs, id_col=id_col, text_col=text_col).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next.text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("id", "n_chars", "root", "marks", "sections", F.col("next.root").alias("next_root"), F.col("next.marks").alias("next_marks"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("edited_sections"), marks(F.col("edited")).alias("edited_marks"))
    rows = rows.withColumn("edited_root", root(F.col("edited_sections"))).withColumn("span", edited_span(F.col("sections"), F.col("edited_sections")))
    near = likeness(F.col("root"), F.col("marks"), F.col("edited_root"), F.col("edited_marks"))
    following = likeness(F.col("root"), F.col("marks"), F.col("next_root"), F.col("next_marks"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"), near.alias("near_edited"), following.alias("near_next"), F.col("span.start").alias("edit_start"), F.col("span.end").alias("edit_end"))
