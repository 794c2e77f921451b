"""Registered queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, editcount, langid, lexical, merkle, negatives, packing, sharding, simhash, tokenfile, urls
from .common import new_path, table

SHARDS = 24
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.digests(spark, path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = docs.select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.item_id", F.col("h.start").alias("start_byte"), F.col("h.end").alias("end_byte"), "h.distance", "h.similarity")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.segments(turns.unionByName(extra)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def edits_of(doc_id, text):
    """Three edits that follow from a row: an insertion, a deletion and a replacement."""
    n = F.length(text)
    at = lambda salt: F.pmod(F.xxhash64(F.lit(salt), doc_id), F.greatest(n, F.lit(1))).cast("long")
    one = lambda start, length, new: F.struct(start.alias("start"), (start + length).alias("end"), F.lit(new).alias("text"))
    return F.when(text.isNull(), None).otherwise(F.array(one(at(1), F.lit(0), " an inserted sentence."), one(at(2), F.lit(40), ""), one(at(3), F.lit(7), "Ersatz\n\n")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return editcount.with_counts(docs, edits_of(F.col("doc_id"), F.col("text"))).select("doc_id", "counts.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_token_orc, op3_packing, op4_decontamination, op5_sharding, op6_chat, op7_url_filter, op8_nearest, op9_token_counts, op10_simhash, op11_lexical_search, op12_fingerprints, op13_hard_negatives, pipeline]
    return {f.__name__: f for f in found}


_URL_SQL = """
WITH rules(rhost, rpath, verdict) AS (VALUES {rules}),
parsed AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
fits AS (SELECT rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS nth
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (rid)
"""


_LEXICAL_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS t FROM documents),
i AS (SELECT DISTINCT row, item_id, t FROM (SELECT row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS t FROM (SELECT row_number() OVER () AS row, item_id, text FROM benchmark))),
c AS (SELECT r, doc_id, t, count(*) AS tf FROM d GROUP BY r, doc_id, t),
size AS (SELECT r, count(*) AS n FROM d GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM size),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM c GROUP BY t), total),
s AS (SELECT row, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // len))))) AS BIGINT) AS score
  FROM i JOIN c USING (t) JOIN w USING (t) JOIN size USING (r), total GROUP BY row, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_MERKLE_SQL = """
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS r, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT r, doc_id, t, n, n // 4 AS q, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM a),
e AS (SELECT *, left(t, n - q) || left(nt, q) AS et FROM p),
f AS (SELECT *, {root_t} AS rt, {root_e} AS re, {root_n} AS rn, {marks_t} AS mt, {marks_e} AS me, {marks_n} AS mn, {flat_t} AS pt, {flat_e} AS pe FROM e),
g AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(pt), len(pe)) + 1), lambda k: pt[k] = pe[k]), false) - 1, least(len(pt), len(pe))) AS front FROM f),
h AS (SELECT *, CAST(coalesce(list_sum(list_transform(pt[1:front], lambda x: length(x))), 0) AS BIGINT) AS b FROM g),
k AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(pt), len(pe)) + 1), lambda k: pt[len(pt) + 1 - k] = pe[len(pe) + 1 - k]), false) - 1, least(len(pt), len(pe))) AS back FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, rt AS fingerprint, re AS edited_fingerprint,
  CASE WHEN rt = re THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(mt, me)) / (len(mt) + len(me) + 2) END AS near_edited,
  CASE WHEN rt = rn THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(mt, mn)) / (len(mt) + len(mn) + 2) END AS near_next,
  CASE WHEN rt <> re THEN b END AS edit_start,
  CASE WHEN rt <> re THEN greatest(b, CAST(n - coalesce(list_sum(list_transform(pt[len(pt) + 1 - back:], lambda x: length(x))), 0) AS BIGINT)) END AS edit_end
FROM k
"""


def _merkle_sql() -> str:
    sections = lambda c: f"string_split(regexp_replace({c}, '(\n\n+)([^\n])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    paragraphs = lambda c: f"regexp_extract_all({c}, '{merkle.PARAGRAPH}')"
    digest = lambda c: f"sha256(array_to_string(list_transform({paragraphs(c)}, lambda y: sha256(y)), ''))"
    root = lambda c: f"sha256(array_to_string(list_transform({sections(c)}, lambda x: {digest('x')}), ''))"
    runs = lambda c: f"list_distinct(flatten(list_transform({paragraphs(c)}, lambda x: regexp_extract_all(x, '{merkle.MARK}'))))"
    made = {f"{name}_{short}": of(c) for short, c in (("t", "t"), ("e", "et"), ("n", "nt")) for name, of in (("root", root), ("marks", runs), ("flat", paragraphs))}
    return _MERKLE_SQL.format(**made)


_NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) AS n FROM s WHERE same) WHERE n <= 5),
g AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(str(r) for r in RULES)
    return {"op7_url_filter": _URL_SQL.format(rules=rules), "op11_lexical_search": _LEXICAL_SQL.replace("{term}", _TERM), "op12_fingerprints": _merkle_sql(), "op13_hard_negatives": _NEGATIVES_SQL}


