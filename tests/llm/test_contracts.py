"""Letters and whole texts of language ID, and how much of a packing the priced columns place."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plugscope.llm import langid, packing, queries, sharding, tokenfile
from plugscope.llm.common import new_path, table
from plugscope.llm.tokens import TOKENIZER, encoder

SF = "/root/testdata/sf0.001"


def test_numerals_are_no_letters(spark):
    rows = [(1, "½ ² Ⅷ ①", 0.0), (2, "12 _ !?", 0.0), (3, "½ a", None), (4, "中", None), (5, "ª", None), (6, None, 0.0), (7, "", 0.0)]
    model = langid.fit(table(spark, "/root/testdata/sf0.001", "documents"))
    got = {r["id"]: r for r in langid.identify(spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string"), model).collect()}
    for i, _, score in rows:
        assert (got[i]["lang_pred"] == "und") == (score == 0.0)
        assert score is None or got[i]["score"] == 0


def test_whole_texts_against_single_windows(spark):
    """A text's score is the softmax of the mean log probabilities of all its windows, the last of which ends with it."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.limit(12).collect()] + ["kurz", "x" * 256, "é" * 400 + " und so weiter", " ".join(f"mot{i}" for i in range(3000))]
    got = [r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).orderBy("id").collect()]
    for text, row in zip(texts, got):
        data = text.encode()
        starts = [min(s, max(0, len(data) - 256)) for s in range(0, max(len(data), 1), 256)]
        logs = []
        for s in starts:
            z = model.logits(np.frombuffer(data[s : s + 256].ljust(256, b"\0"), np.uint8)[None])[0].astype(float)
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        mean = np.mean(logs, axis=0)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert row["lang_pred"] == model.langs[int(p.argmax())] and abs(row["score"] - p.max()) < 1e-3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=41, max_size=41), st.integers(0, 3))
def test_bounded_knapsack_against_brute_force(counts, waste):
    """The column is feasible, fills the length, and no other such column is worth more."""
    left = np.array([0] + counts[:40])
    left[12:] = 0  # few enough for brute force
    prices = np.arange(41) / 40 + np.sin(np.arange(41)) / 50
    got = packing.bounded_knapsack(prices, left, 40, waste, np.inf)
    best = {0: 0.0}
    for size in range(1, 12):
        for _ in range(left[size]):
            for total, value in list(best.items()):
                if total + size <= 40:
                    best[total + size] = max(best.get(total + size, -1), value + prices[size])
    fits = [v for t, v in best.items() if t >= 40 - waste]
    if got is None:
        assert not fits
    else:
        assert (got <= left).all() and 40 - waste <= got @ np.arange(41) <= 40
        assert abs(got @ prices - max(fits)) < 1e-9


def test_priced_columns_place_nearly_all(spark):
    encode, demand = encoder(TOKENIZER).encode, np.zeros(packing.LENGTH, np.int64)
    for r in table(spark, "/root/testdata/sf0.01", "documents").select(F.coalesce("text", F.lit("")).alias("t")).collect():
        demand[(len(encode(r["t"])) // 4 + 1) % packing.LENGTH] += 1
    made = packing.plan(demand)
    assert sum(made.covered) >= 0.95 * demand[1:].sum()
    assert made.tail <= 0.1 * (made.copies + made.tail)


def test_shard_sizes_and_digests(spark):
    """Sizes and digests of every row against Python's, over the whole table and over odd texts."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    for r in queries.op5_sharding(spark, SF).collect():
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    odd = [(1, None), (2, ""), (3, "é🙂"), (3, "é🙂"), (4, "x" * 100_000)]
    got = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard(spark.createDataFrame(odd, "doc_id long, text string"), 24).collect())
    assert got == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd)


def test_token_files_of_odd_rows(spark):
    """Ids of null, empty, repeated and special texts are the library's, with its default settings."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(1, None, 5), (2, "", 5), (3, "one <|endoftext|> two", 5), (4, "é🙂\\n\\n  x", 5), (4, "é🙂\\n\\n  x", 5), (5, "w " * 9000, 5)]
    path = new_path(spark, "odd-orc")
    tokenfile.write(spark.createDataFrame(odd, "doc_id long, text string, n_tokens int"), path)
    got, start = [], 0
    want = []
    for i, text, _ in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = sorted(tokenfile.digests(spark, path).collect(), key=lambda r: r["start"])
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        got.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    assert sorted(got) == sorted(want) and [g[0] for g in got] == sorted(g[0] for g in got)
