"""Ranked search, Merkle fingerprints and hard negatives against SQL, brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plugscope.llm import lexical, merkle, negatives, queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "embeddings"]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_fingerprints", "op13_hard_negatives"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    flat = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert len(got) == len(want) and flat(got.astype(str)) == flat(want.astype(str))


# 11

def brute_rank(docs, items, k, once=True):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    own = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    sizes = [c.total() for _, c in own]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall(lower(text)))
        found = []
        for (i, c), s in zip(own, sizes):
            if s:
                m = 50 + 50 * s * n // length
                score = sum((1 if once else asked[t]) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
                if score > 0:
                    found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD_DOCS = [(1, "Alpha beta GAMMA"), (2, "alpha"), (3, None), (4, ""), (5, "...!"), (None, "beta Éa Éa"), (6, "alpha"), (6, "alpha"), (7, "éa 12ab 12AB" + " filler" * 500), (8, "x" * 3000 + " alpha")]
ODD_ITEMS = [(1, "alpha alpha beta"), (2, None), (3, ""), (None, "Éa 12ab"), (1, "gamma"), (4, "nowhere")]


@pytest.mark.parametrize("pairs", [1 << 20, 3])
@pytest.mark.parametrize("once", [True, False])
def test_ranking(spark, monkeypatch, pairs, once):
    """Nulls, empties, ties, repeats, extra columns, one block and several."""
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    docs = spark.createDataFrame([(i, t, 9, "n") for i, t in ODD_DOCS], "doc_id long, text string, n int, score string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ODD_ITEMS], "item_id long, text string, row int")
    assert rows_of(lexical.rank(docs, items, k=3, once=once)) == brute_rank(ODD_DOCS, ODD_ITEMS, 3, once)


def test_ranking_of_empty_tables(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []
    assert lexical.rank(docs.where("doc_id = 5"), items).collect() == []


def test_terms_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert lexical.term_counts(text) == whole and lexical.term_counts(None) == {}


# 12

def brute_root(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections = re.split(r"(?<=\n\n)(?=[^\n])", text)
    return sha("".join(sha("".join(sha(p) for p in re.findall(r"[^\n]*\n+|[^\n]+", s))) for s in sections))


TEXTS = [(3, "One two.\nThree four.\n\nFive six seven eight nine ten.\n"), (1, "a b c d e f g h " * 40), (2, None), (None, "tail é🙂 text"), (4, ""), (5, "same"), (5, "same"), (5, "other"), (6, "\n\n\nx\n\ny\n\n"), (7, "z" * 70_000 + "\n" + "k l m\n" * 3000)]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_next_rows(spark, ranges):
    """Rows are paired in order of id, whatever the ranges; nulls last, ties by digest."""
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in TEXTS], "doc_id long, text string, root string, sections string").repartition(3)
    got = merkle.with_next(docs, ranges=ranges).select("id", "text", "next.text", "root").collect()
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    order = sorted(TEXTS, key=key)
    want = [(i, t or "", order[(k + 1) % len(order)][1] or "", brute_root(t or "")) for k, (i, t) in enumerate(order)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_hot_id_is_split(spark):
    docs = spark.range(400).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    texts = {r["doc_id"]: [] for r in docs.collect()}
    rows = sorted(((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest(), r["text"]) for r in docs.collect()))
    want = {t: rows[(k + 1) % len(rows)][2] for k, (_, _, t) in enumerate(rows)}
    got = {r["text"]: r["n"] for r in merkle.with_next(docs, ranges=20).select("text", F.col("next.text").alias("n")).collect()}
    assert got == want and texts


def test_fingerprints(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = merkle.fingerprints(docs).toPandas()
    assert len(got) == len(TEXTS)
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert ((got["near_edited"] == 1) == (got["fingerprint"] == got["edited_fingerprint"])).all()
    long = got[got["doc_id"] == 1].iloc[0]
    assert long["n_chars"] == 640 and long["edit_start"] == 0 and long["edit_end"] == 640  # one paragraph
    assert merkle.fingerprints(docs.limit(0)).collect() == []
    one = merkle.fingerprints(docs.where("doc_id = 4")).collect()[0]
    assert (one["near_edited"], one["near_next"]) == (1, 1)


def test_edits_are_located(spark):
    """The span holds every character that changed, and ends at paragraphs."""
    rng, rows = random.Random(5), []
    for _ in range(60):
        a = "".join(rng.choice(["ab ", "c\n", "d\n\n", "é"]) for _ in range(rng.randint(1, 30)))
        s, n = rng.randrange(len(a)), rng.randint(0, 5)
        rows.append((a, a[:s] + rng.choice(["", "new", "x\n", "\n\n"]) + a[s + n :]))
    rows += [("", "a"), ("a", ""), ("", ""), ("a\n", "a\n\n")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", merkle.edited_span(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("s")).collect():
        if r["a"] == r["b"]:
            assert r["s"] is None
            continue
        start, end = r["s"]
        assert 0 <= start <= end <= len(r["a"])
        assert r["a"][:start] == r["b"][:start]
        rest = len(r["a"]) - end
        assert rest == 0 or r["a"][-rest:] == r["b"][-rest:]


def test_likeness_follows_edits(spark):
    words = [f"w{i}" for i in range(400)]
    text = "\n".join(" ".join(words[i : i + 20]) for i in range(0, 400, 20))
    small = text.replace("w399", "other")
    df = spark.createDataFrame([(text, small, " ".join(reversed(words)))], "a string, b string, c string")
    near = lambda x, y: merkle.likeness(merkle.root(merkle.tree(F.col(x))), merkle.marks(F.col(x)), merkle.root(merkle.tree(F.col(y))), merkle.marks(F.col(y)))
    same, edited, far = df.select(near("a", "a"), near("a", "b"), near("a", "c")).first()
    assert same == 1 and 0.95 < edited < 1 and far == 0


def test_fingerprints_stay_native(spark):
    plan = merkle.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning(range") <= 2  # the texts, and one row a range


# 13

def brute_negatives(rows, positives=5, negatives_=5, low=80):
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    rows = [(i, y, np.floor(256 * np.array(v, float)).astype(int)) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max(len(v) for *_, v in rows)
    rows = [(i, y, np.pad(v, (0, d - len(v)))) for i, y, v in rows]
    out = []
    for a, (aid, ay, av) in enumerate(rows):
        if aid is None or aid % 100:
            continue
        scored = [(int(av @ v), i, y) for b, (i, y, v) in enumerate(rows) if b != a]
        for p, pid, _ in sorted((s for s in scored if s[2] == ay), key=key)[:positives]:
            found = sorted((s for s in scored if s[2] != ay and low * p <= 100 * s[0] <= 100 * p), key=key)[:negatives_]
            out += [(aid, pid, r, i, p, s) for r, (s, i, _) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [25_000, 37])
def test_negatives(spark, monkeypatch, block):
    """Random vectors with nulls, ties, repeats and hot copies, in one block and in several."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", 3 if block == 37 else 4096)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((260, 40)) * np.linspace(2, 0.1, 40)
    rows = [(i * 10, int(rng.integers(3)), base[i].tolist()) for i in range(260)]
    rows += [(100, 1, base[5].tolist()), (100, 1, base[5].tolist()), (None, 1, base[6].tolist()), (None, 2, base[6].tolist()), (7, None, base[1].tolist()), (8, 1, None), (9, 1, [1.0, None]), (11, 1, [math.nan]), (13, 0, [math.inf]), (15, 2, [0.5, 1.0]), (300_000, 2, [])]
    rows += [(1000 + i, i % 3, base[0].tolist()) for i in range(90)]
    df = spark.createDataFrame([(i, y, v, 1, 2) for i, y, v in rows], "vec_id long, label int, embedding array<double>, x int, row int")
    got = rows_of(negatives.mine(df, F.col("vec_id") % 100 == 0))
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.5]), (4, 2, [1e300])]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(negatives.mine(df, F.col("vec_id") % 100 == 0)) == brute_negatives(rows[:4])


def test_bounds_discard_rows():
    """Bounds hold every product, and leave few rows where leading components carry most of it."""
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((3000, 64)) * np.geomspace(300, 1, 64)).astype(np.int64)
    turn = negatives.rotation(x.astype(float))
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-12)
    rows = negatives._Rows(pd.Series([v.tobytes() for v in x]), turn)
    pool, tile = np.arange(3000), np.arange(20)
    for c in negatives.STAGES:
        low, high = rows.bounds(c, pool, rows, tile, rows.y[pool, :c] @ rows.y[tile, :c].T)
        exact = x @ x[tile].T
        assert (low <= exact).all() and (exact <= high).all()
    keep = lambda j, at, lower, upper: upper >= negatives._floor(lower, 5)
    for j, alive in negatives._surviving(rows, rows, tile, pool, keep):
        best = np.sort(x @ x[j])[-5:]
        assert set(np.flatnonzero(x @ x[j] >= best[0])) <= set(alive) and len(alive) < 150
