"""Operators of plugscope.llm against brute force, round trips and edge cases."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plugscope.llm import ann, chat, decontaminate, editcount, langid, packing, queries, sharding, simhash, tokenfile, tokens, urls
from plugscope.llm.common import new_path, shared_dir, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, hits string, lang_pred string, fp int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, ties, repeats, long texts, clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[i * 7 % 10] + str(i % 53) for i in range(30_000))
    rows = [(1, "one two three four five six seven", "en"), (2, "one two three four five six seven", "en"), (3, None, None), (4, "", "fr"), (None, "le chat est sur la table", "fr"), (5, long, "en"), (5, long, "en"), (6, "12 34 !!", "de"), (7, "  a\n\n b \t c  ", "en"), (8, "x" * 5000, None)]
    return spark.createDataFrame([(i, t, g, None, None, 1, "h", "p", 2) for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def pdf_of(spark):
    return table(spark, SF, "documents").toPandas()


# tokens

@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0  '’sdtm.,é漢🙂٣½_<|>"), st.characters(codec="utf-8"))))
def test_encoder_is_the_librarys(text):
    t = test_encoder_is_the_librarys.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_PARTS = st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "\n", "ab", "é", "'s", " 12", "."])


@settings(max_examples=50, deadline=None)
@given(st.lists(_PARTS, max_size=12).map("".join))
def test_added_tokens_are_the_librarys(text):
    t = test_added_tokens_are_the_librarys.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder().encode("one two<|endoftext|>three"), "<u4").tolist() == [505, 734, 50256, 15542]


def test_edit_counts_with_added_tokens(monkeypatch):
    monkeypatch.setattr(editcount, "SEGMENT", 16)
    rng, enc = np.random.default_rng(2), tokens.encoder()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(200):
        now = "".join(rng.choice(["<|endoftext|>", " ", "word", " long words", "\n"], 40))
        tree = editcount.SegmentTree(now, enc)
        for _ in range(4):
            s, n, new = int(rng.integers(len(now))), int(rng.integers(20)), str(rng.choice(["<|endoftext|>", "|>", "<|endof", " x", ""]))
            tree.edit(s, s + n, new)
            now = now[:s] + new + now[s + n :]
            assert tree.text() == now and tree.total == len(t.encode(now, add_special_tokens=False).ids)


# 1

def test_language_id(spark):
    docs = table(spark, SF, "documents")
    got = queries.op1_language_id(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.9
    assert got["score"].between(0, 1).all()


def test_forward_pass_against_loops():
    """The batched network equals one written with loops over positions, widths and filters."""
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    m = langid.train(rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40), ["a", "b", "c"])
    for w, got in zip(windows, m.logits(windows)):
        hidden = []
        for f in range(langid.FILTERS * len(langid.WIDTHS)):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = m.kernel.reshape(max(langid.WIDTHS), langid.EMBED, -1)[:, :, f]
            assert not kernel[width:].any()
            best = max(sum(float(m.embed[w[p + j]] @ kernel[j]) for j in range(width)) for p in range(langid.WINDOW - max(langid.WIDTHS) + 1))
            hidden.append(max(best + m.bias[f], 0))
        assert np.allclose(got, np.array(hidden) @ m.dense + m.offset, atol=1e-3)


def test_every_labelled_language_is_a_class(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 40, f"l{i % 80:02d}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == [f"l{k:02d}" for k in range(80)]


def test_one_id_does_not_unbind_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(langid, "STEPS", 2)
    rows = [(None, "same words here", "a")] * 300 + [(7, "andere Worte", "b")] * 300
    seen = []
    monkeypatch.setattr(langid, "train", lambda w, y, names, seed=7: seen.append((len(w), names)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen == [] or seen[0][0] <= 2 * 3 * 10  # windows of two languages


def test_language_edges(spark, docs, empty):
    model = langid.train(*_toy_windows())
    got = langid.identify(docs, model).toPandas()
    assert len(got) == 10 and set(docs.columns) <= set(got.columns)
    none = got[got["text"].isna() | (got["text"] == "") | (got["text"] == "12 34 !!")]
    assert (none["lang_pred"] == "und").all() and (none["score"] == 0).all()
    assert langid.fit(empty) is None
    assert set(langid.identify(docs, None).toPandas()["lang_pred"]) == {"und"}
    assert langid.identify(empty, model).count() == 0


def _toy_windows():
    texts = [b"the cat sat on the mat " * 20, b"der hund und die katze " * 20]
    w, n = langid.windows_of(texts)
    return w, np.repeat([0, 1], n), ["de", "en"]


@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=5))
@settings(max_examples=50, deadline=None)
def test_windows_cover_whole_texts(texts):
    w, n = langid.windows_of(texts)
    at = 0
    for t, k in zip(texts, n):
        own = w[at : at + k]
        at += k
        if len(t) <= langid.WINDOW:
            assert own[0].tobytes().rstrip(b"\0") == t.rstrip(b"\0")
        else:
            assert b"".join(x.tobytes() for x in own[:-1]) == t[: (k - 1) * langid.WINDOW] and own[-1].tobytes() == t[-langid.WINDOW :]


# 2

def test_token_file(spark, reference):
    got = queries.op2_token_orc(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    src = pdf_of(spark).sort_values("doc_id")
    start = 0
    for r, text in zip(got.itertuples(), src["text"]):
        ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_layout(spark, docs, empty):
    import glob

    import pyarrow.orc as orc

    path = new_path(spark, "t-orc")
    tokenfile.write(docs, path)
    assert tokenfile.digests(spark, path).count() == 10
    assert tokenfile.read(spark, path, F.col("doc_id") == 7).count() == 1
    files = glob.glob(path.removeprefix("file://") + "/*.orc")
    assert sum(orc.ORCFile(f).nrows for f in files) == 10
    path = new_path(spark, "t-orc")
    tokenfile.write(empty, path)
    assert tokenfile.digests(spark, path).count() == 0


def rows_scanned(df):
    """Rows that the scan of an executed query gave on, after stripes and row groups were pruned."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_are_pruned_by_metadata(spark):
    import glob

    import pyarrow.orc as orc

    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text")).repartition(3)
    path = new_path(spark, "t-orc")
    tokenfile.write(docs, path)
    files = [orc.ORCFile(f) for f in glob.glob(path.removeprefix("file://") + "/*.orc")]
    assert sum(f.nrows for f in files) == 20_000 and {f.row_index_stride for f in files if f.nrows} == {1000}
    assert rows_scanned(tokenfile.read(spark, path)) == 20_000
    assert rows_scanned(tokenfile.read(spark, path, F.col("doc_id") == 7776)) <= 1000  # one row group
    absent = [rows_scanned(tokenfile.read(spark, path, F.col("doc_id") == k)) for k in range(7001, 7021, 2)]
    assert sum(x == 0 for x in absent) >= 8  # within the bounds of a row group, refused by its Bloom filter


# 3

def check_packing(pieces, ids_of):
    by_doc = pieces.sort_values("start").groupby("doc_id", dropna=False)
    for doc, g in by_doc:
        want = ids_of(doc)
        at = 0
        for r in g.itertuples():
            if r.start == 0 and at == len(want):  # a repeated document
                at = 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want) and r.length > 0
        assert g["length"].sum() % len(want) == 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all()
        assert g["length"].sum() <= 1024


def test_packing(spark, docs, empty, reference):
    got = queries.op3_packing(spark, SF).toPandas()
    text = dict(zip(*pdf_of(spark)[["doc_id", "text"]].to_numpy().T))
    check_packing(got, lambda d: reference.encode(text[d] or "", add_special_tokens=False).ids + [0])
    pad = packing.padding(spark.createDataFrame(got[["sequence_id", "length"]])).first()
    assert pad["padding"] <= 1023 + packing.WASTE * pad["sequences"]
    small = packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).toPandas()
    own = {1: "one two three four five six seven", 3: "", 4: ""}
    check_packing(small[small["doc_id"].isin([1, 3, 4])].assign(offset=0, sequence_id=lambda d: range(len(d))), lambda d: reference.encode(own[d], add_special_tokens=False).ids + [0])
    for _, g in small.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all()
    assert packing.pack(empty).count() == 0


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    prices = rng.random(13)
    prices[0] = 0
    value, pattern = packing.knapsack(prices, 12)
    best = np.zeros(13)
    for room in range(1, 13):
        best[room] = max(best[room - 1], max(prices[s] + best[room - s] for s in range(1, room + 1)))
    assert np.isclose(value, best[12]) and np.isclose(pattern @ prices, value) and pattern @ np.arange(13) <= 12


def test_patterns_carry_nearly_all_remainders():
    rng = np.random.default_rng(5)
    for n in (200, 2000, 100_000):
        demand = np.bincount(np.minimum(rng.lognormal(5, 1.2, n).astype(int) + 1, 1023), minlength=1024)
        got = packing.plan(demand)
        assert got.tail <= 2  # sequences of remainders that no pattern holds


def test_many_tasks_without_broadcast(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = packing.pack(docs.repartition(5, "doc_id")).drop("ids")
    want = sorted(map(tuple, want.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    monkeypatch.setattr(packing, "MOST_BYTES", 0)
    got = packing.pack(docs.repartition(5, "doc_id")).drop("ids").toPandas()
    assert sorted(got.groupby("doc_id").agg({"length": "sum", "doc_tokens": "max"}).itertuples(name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all()


@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
@settings(max_examples=40, deadline=None)
def test_plan_places_each_remainder_once(demand):
    p = packing.plan(np.array(demand), 16, 1)
    used = {}
    for size in range(1, 16):
        for rank in range(demand[size]):
            at = 0
            for first, length, sequence, offset in p.place(size, rank):
                assert first == at
                at += length
                for k in range(offset, offset + length):
                    assert (sequence, k) not in used
                    used[sequence, k] = 1
            assert at == size
    for s in {s for s, _ in used}:
        held = sorted(k for q, k in used if q == s)
        assert held == list(range(len(held))) and len(held) <= 16
        assert s >= p.copies or len(held) >= 15


# 4

def test_decontamination(spark, docs, empty):
    bench = table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, SF).collect()}
    norm = lambda t: decontaminate.normalise((t or "").encode())[0].tobytes()
    src, items = pdf_of(spark), bench.toPandas()
    exact = {(d, i) for d, t in zip(src["doc_id"], src["text"]) for i, x in zip(items["item_id"], items["text"]) if norm(x)[1:-1] in norm(t)}
    assert exact and exact <= got
    hit = decontaminate.with_hits(docs, bench)
    assert hit.count() == 10 and hit.where(F.size("hits") > 0).count() == 0
    assert decontaminate.with_hits(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    assert decontaminate.with_hits(empty, bench).count() == 0


def test_recall_of_edited_passages(spark):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    index = decontaminate.build(items)
    rng = np.random.default_rng(5)
    texts = [t.encode() for t in pdf_of(spark)["text"][:40]]
    met = 0
    for k, (item, text) in enumerate(items):
        spoiled = decontaminate._edited(np.frombuffer(text.encode(), np.uint8), decontaminate.DESIGN_EDITS, rng).tobytes()
        doc = texts[k % 40] + b" " + spoiled + b" " + texts[(k + 1) % 40]
        met += any(h[0] == item for h in decontaminate.search(index, [doc])[0])
    assert met >= 0.95 * len(items)


@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_recall_up_to_the_bound(spark, rate):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    index = decontaminate.build(items)
    rng = np.random.default_rng(6)
    around = [decontaminate.normalise(t.encode())[0].tobytes()[:2000] for t in pdf_of(spark)["text"][:40]]
    docs_, want = [], []
    for k, (item, text) in enumerate(items * 3):
        plain = decontaminate.normalise(text.encode())[0][1:-1]
        doc = around[k % 40] + decontaminate._edited(plain, rate, rng).tobytes() + around[(k + 1) % 40]
        if decontaminate.best_place(plain.tobytes(), doc, int(decontaminate.MOST_EDITS * len(plain))):
            docs_.append(doc)
            want.append(item)
    met = [item in [h[0] for h in hits] for item, hits in zip(want, decontaminate.search(index, docs_))]
    assert len(met) >= 40 and np.mean(met) >= decontaminate.RECALL


def test_exact_copies_of_every_item():
    texts = ["столица Российской Федерации", "What is the capital city of France?", "中国的首都是北京市而不是上海市也不是广州市吗请回答", "东京都", "internationalization standardization committees documentation"]
    index = decontaminate.build(list(enumerate(texts)))
    for phase in range(4):
        doc = "a " * phase + f"x {texts[0]} и {texts[1].upper()} 我们知道{texts[2]}了{texts[3]}的 {texts[4]} z"
        assert [(h[0], h[3]) for h in decontaminate.search(index, [b"y", doc.encode()])[1]] == [(k, 0) for k in range(5)]
    assert decontaminate.search(decontaminate.build([(1, "the cat")]), [b"bathe cat", b"the cats", b"The, cat!"])[2][0][:3] == (1, 0, 8)


def test_hits_against_brute_force(spark):
    """Every hit is within the bound, and nearly all pairs within it are hits."""
    texts = [r["text"] for r in table(spark, SF, "documents").where("length(text) between 1 and 3000").orderBy("doc_id").limit(50).collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").orderBy("item_id").limit(20).collect()]
    rng = np.random.default_rng(3)
    for k, rate in enumerate([0.05, 0.1, 0.15] * 8):
        edited = decontaminate._edited(np.frombuffer(items[k % 20][1].lower().encode(), np.uint8), rate, rng)
        texts.append(f"{texts[k]} {edited.tobytes().decode('utf-8', 'replace')} {texts[k + 1]}")
    index = decontaminate.build(items)
    got = {(d, h[0]) for d, hits in enumerate(decontaminate.search(index, [t.encode() for t in texts])) for h in hits}
    want = set()
    for d, text in enumerate(texts):
        norm = decontaminate.normalise(text.encode())[0].tobytes()
        want |= {(d, item) for (item, _), own in zip(items, index.texts) if decontaminate.best_place(own, norm, int(0.2 * len(own)))}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 20


def test_hits_do_not_depend_on_neighbours_or_blocks(spark, monkeypatch):
    docs, items = table(spark, SF, "documents").where("length(text) < 5000").limit(80), table(spark, SF, "benchmark")
    index = decontaminate.build([(r["item_id"], r["text"]) for r in items.collect()])
    rows = docs.collect()
    alone = {r["doc_id"]: decontaminate.search(index, [(r["text"] or "").encode()])[0] for r in rows}
    together = decontaminate.search(index, [(r["text"] or "").encode() for r in rows])
    assert [alone[r["doc_id"]] for r in rows] == together
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 3000)
    kept = spark.createDataFrame(rows, docs.schema)
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"] if h["distance"] == 0} for r in decontaminate.with_hits(kept, items).collect()}
    assert got == {d: {h[0] for h in hits if h[3] == 0} for d, hits in alone.items()}


def test_least_distances_are_exact():
    rng = np.random.default_rng(0)
    for low, high in ((1, 8), (20, 50), (50, 64)):
        own = [bytes(rng.integers(97, 100, rng.integers(low, high + 1)).astype(np.uint8)) for _ in range(40)]
        regions = [decontaminate._edited(np.frombuffer(i, np.uint8), 0.2, rng).tobytes() + b"abc" * int(rng.integers(9)) for i in own]
        assert decontaminate.least_distances(own, regions).tolist() == [decontaminate.best_place(i, r, len(i))[0] for i, r in zip(own, regions)]


def test_pieces_give_up_no_pair_within_the_bound():
    rng = np.random.default_rng(1)
    pairs = []
    for size in (50, 64, 65, 130, 300):
        pad = b"z" * (size // 5 + 2)
        for _ in range(30):
            item = rng.integers(97, 101, size).astype(np.uint8)
            region = decontaminate._edited(item, float(rng.choice([0.1, 0.2, 0.4])), rng).tobytes() + b"abcd" * int(rng.integers(9))
            pairs.append((item.tobytes(), pad + region + pad, size // 5))
    within = [decontaminate.best_place(i, r, m) is not None for i, r, m in pairs]
    kept = decontaminate.hopeful(pairs)
    assert all(k for k, w in zip(kept, within) if w) and 0 < sum(kept) < len(pairs)


@given(st.binary(min_size=1, max_size=12), st.binary(max_size=30))
@settings(max_examples=200, deadline=None)
def test_best_place_is_exact(item, text):
    def least():
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    found = decontaminate.best_place(item, text, len(item))
    assert found[0] == least() and found[1] <= found[2]
    assert decontaminate.hopeful([(item, text, found[0])])[0]


# 5

@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, docs, empty, shards):
    got = sharding.shard(docs, shards).toPandas()
    assert len(got) == 10
    n = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    one = got[got["doc_id"] == 1].iloc[0]
    assert one["size"] == 33 + 8 and one["text_crc32"] == zlib.crc32(b"one two three four five six seven")
    assert (got[got["doc_id"] == 3]["size"] == 8).all()
    assert sharding.shard(empty, shards).count() == 0


def test_sharding_moves_little(spark):
    d = table(spark, SF, "documents")
    a = sharding.shard(d, 24).toPandas().set_index("doc_id")["shard"]
    b = sharding.shard(d, 25).toPandas().set_index("doc_id")["shard"]
    assert (a != b.reindex(a.index)).mean() < 0.5
    counts = np.array([5, 0, 9, 1])
    plan = sharding.runs(counts, np.array([0, 1, 0, 2]), np.array([5, 5, 5]))
    assert sum(hi - lo for _, lo, hi, _, _ in plan) == 15


def test_ring_against_brute_force():
    """Each key goes clockwise to the first node of a shard with room, arcs in order, as a plain walk says."""
    rng = np.random.default_rng(2)
    places, owners = sharding.ring(5, 7)
    arcs = np.searchsorted(places, rng.integers(0, 2**64, 400, dtype=np.uint64)) % len(places)
    counts, room = np.bincount(arcs, minlength=len(places)), sharding.capacities(400, 5)
    got = {(arc, r): s for arc, lo, hi, s, _ in sharding.runs(counts, owners, room) for r in range(lo, hi)}
    left, want, spilled = room.copy(), {}, []
    for arc, n in enumerate(counts):
        for r in range(n):
            if left[owners[arc]]:
                left[owners[arc]] -= 1
                want[arc, r] = owners[arc]
            else:
                spilled.append((arc, r))
    for arc, r in spilled:
        step = next(s for s in range(1, len(owners)) if left[owners[(arc + s) % len(owners)]])
        want[arc, r] = owners[(arc + step) % len(owners)]
        left[want[arc, r]] -= 1
    assert got == want and not left.any()


def test_one_more_shard_moves_few_keys():
    keys = sharding._mix(np.arange(1, 100_001).astype(np.uint64))
    shard_of = {}
    for shards in (24, 25):
        places, owners = sharding.ring(shards)
        arcs = np.searchsorted(places, keys) % len(places)
        order = np.lexsort((keys, arcs))
        counts = np.bincount(arcs, minlength=len(places))
        first = np.cumsum(counts) - counts
        own = np.empty(len(keys), int)
        for arc, lo, hi, s, _ in sharding.runs(counts, owners, sharding.capacities(len(keys), shards)):
            own[order[first[arc] + lo : first[arc] + hi]] = s
        shard_of[shards] = own
    assert 0.04 <= (shard_of[24] != shard_of[25]).mean() < 0.12  # a 25th, and what the bounds pass on


# 6

def expected_chat(rows):
    out = {}
    for conv, g in rows.groupby("conv_id"):
        g = g.sort_values("turn")
        turns = "".join(f"{r}\n{t or ''}\n" for r, t in zip(g["role"], g["text"]))
        loss = "".join(t or "" for r, t in zip(g["role"], g["text"]) if r == "assistant")
        out[conv] = (len(g), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    rows = table(spark, SF, "conversations").toPandas()
    said = "</s>[INST] ok [/INST]"
    rows = pd.concat([rows, pd.DataFrame({"conv_id": [-1, -1], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})])
    want = expected_chat(rows)
    got = queries.op6_chat(spark, SF).toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[r.conv_id]


@given(st.text(alphabet="</s>[INT] \\SYOURE|a\n"))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    t = chat.Template()
    safe = chat.escape(text, t)
    assert chat.unescape(safe) == text and not any(c in safe for c in t.controls)


ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]\\"])


@given(st.lists(st.tuples(ROLES, st.text(alphabet="</s>[INT] \\SYOURE|a\n", max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_formatted_text_is_parsed_back(turns):
    t = chat.Template()
    joined = "".join(t.marks(r)[0] + chat.escape(x, t) + t.marks(r)[1] for r, x in turns)
    assert chat.parse(joined, t) == turns


def test_chat_edges(spark):
    rows = [(1, 0, "assistant", "x"), (1, 1, "user", None), (None, 0, None, "a"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "v"), (3, 0, "tool[/ROLE]", "\\"), (3, 0, "tool[/ROLE]", "\\"), (4, None, "user", "q")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, state string")
    got = {r["conv_id"]: r for r in chat.digests(chat.segments(df)).collect()}
    assert got[2]["valid"] and not got[1]["valid"] and got[3]["n_turns"] == 2
    assert got[3]["turns_sha256"] == hashlib.sha256(b"tool[/ROLE]\n\\\ntool[/ROLE]\n\\\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\na\n").hexdigest()
    assert chat.digests(chat.segments(df.limit(0))).count() == 0
    flags = chat.segments(df.where("conv_id = 2")).where("loss").collect()
    assert [r["content"] for r in flags] == ["v"]


# 7

def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_urls(spark, monkeypatch):
    given_urls = ["http://Example.COM/en/x?y", "https://www.example.com/en/", "http://a.net/es/q#z", "http://net/fr/", "http://xnet/fr/", "nothing", None, "", "http://", "http://example.com", "http://example.com?x=/en/", "x://y://z.com/", "http://" + "a." * 500 + "com/" + "p/" * 3000, "http://example.com:80/en/"]
    pages = spark.createDataFrame([(i % 5, u, None, "r") for i, u in enumerate(given_urls)] + [(0, given_urls[0], None, "r")], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(queries.RULES + [(None, "/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    want = sorted([(i % 5, *map(str, judged(u, queries.RULES))) for i, u in enumerate(given_urls)] + [(0, *map(str, judged(given_urls[0], queries.RULES)))])
    read = lambda df: sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in df.collect())
    assert read(urls.judge(pages, rules)) == want
    monkeypatch.setattr(urls, "SMALL", 0)
    assert read(urls.judge(pages, rules)) == want
    assert urls.judge(pages, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == len(want)
    assert urls.judge(pages.limit(0), rules).count() == 0


# 8

def brute(ids, x, queries_, k=20):
    out = {}
    for q in queries_:
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_nearest(spark):
    e = table(spark, SF, "embeddings").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), np.float64)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    got = queries.op8_nearest(spark, SF).toPandas()
    met = total = 0
    for q, near in want.items():
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        met += len(set(own["vec_id"]) & {i for i, _ in near})
        total += len(near)
        known = dict(zip(ids, x))
        assert all(np.isclose(r.score, known[r.vec_id] @ known[q], atol=1e-12) for r in own.itertuples())
    assert met / total >= 0.9


def test_nearest_meets_few_rows(spark, monkeypatch):
    """20,000 vectors in no clusters: recall of 0.9 from rows of met leaves, which are a fraction of all."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = ann.fit_forest(x[:10_000], 1.0)
    budget, leaf = ann.calibrate(forest, x[:10_000], 20), forest.assign(x)
    met = [np.unpackbits(forest.met(q, budget), count=forest.leaves)[leaf].any(axis=1).mean() for q in x[::400]]
    print(f"share of rows met: {np.mean(met):.3f}")
    assert np.mean(met) < 0.35
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})).repartition(8)
    got = ann.search(df, F.col("id") % 200 == 0).toPandas().groupby("query_id")["vec_id"].agg(set)
    want = brute(np.arange(len(x)), x, np.arange(0, len(x), 200))
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nearest_in_blocks(spark, monkeypatch):
    """Rows and queries over many tasks give all of brute force where all rows are scored."""
    monkeypatch.setattr(ann, "BLOCK", 70)
    monkeypatch.setattr(ann, "CHUNK", 9)
    e = table(spark, SF, "embeddings").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), np.float64)
    got = ann.search(table(spark, SF, "embeddings"), F.col("id") % 20 == 0, target=1.0).toPandas()
    for q, near in brute(ids, x, np.flatnonzero(ids % 20 == 0)).items():
        assert list(got[got["query_id"] == q].sort_values("rank")["vec_id"]) == [i for i, _ in near]


def test_nearest_edges(spark):
    rng = np.random.default_rng(0)
    base = [float(v) for v in rng.standard_normal(8)]
    rows = [(i, base) for i in range(0, 60)] + [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(60, 100)]
    rows += [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0, None] + [0.0] * 6), (280, [1.0]), (None, base)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = ann.search(df, F.col("id") % 20 == 0).toPandas()
    assert set(got["query_id"]) == {0, 20, 40, 60, 80, 280}  # a short vector lacks components, which count as zero
    own = got[got["query_id"] == 20].sort_values("rank")
    if np.dot(base, base) >= max(np.dot(base, np.array(v)) for i, v in rows[60:100]):
        assert list(own["vec_id"]) == [i for i in range(21) if i != 20]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 61, 62)"), F.col("id") % 20 == 0).toPandas()
    assert sorted(few["vec_id"]) == [61, 62]


def test_nearest_repeated_ids(spark):
    rng = np.random.default_rng(4)
    made = lambda: [float(v) for v in rng.standard_normal(8)]
    base = made()
    rows = [(20, base)] * 30 + [(40, [3 * x + 0.01 * y for x, y in zip(base, made())]) for _ in range(30)] + [(i, made()) for i in range(101, 161) if i % 20] + [(103, made())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    s = (x * np.array(base)).sum(axis=1)
    want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != 20][:20]
    got = ann.search(df, F.col("id") == 20, target=1.0).toPandas()
    assert len(got) == 30 * 20
    for rank, own in got.groupby("rank"):
        assert set(own["vec_id"]) == {want[rank - 1]}
    got = ann.search(df, F.col("id") == 40, target=1.0).toPandas()
    assert len(got) == 30 * 20 and (got["vec_id"] != 40).all()


# 9

@given(st.text(alphabet="ab 'sé.\n\t12  ", max_size=300), st.lists(st.tuples(st.integers(-5, 320), st.integers(-5, 320), st.text(alphabet="xy \n.é", max_size=12)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_edit_counts(text, edits):
    enc, old = tokens.encoder(), editcount.SEGMENT
    editcount.SEGMENT = 16
    try:
        tree = editcount.SegmentTree(text, enc)
        now = text
        assert tree.total == enc.count(now)
        for s, e, new in edits:
            tree.edit(s, e, new)
            s = min(max(s, 0), len(now))
            now = now[:s] + new + now[min(max(e, s), len(now)) :]
            assert tree.text() == now and tree.total == enc.count(now) and tree.sizes[1] == len(now)
    finally:
        editcount.SEGMENT = old


def test_stored_trees_take_later_edits(spark, reference):
    docs = table(spark, SF, "documents").where("length(text) > 3000").limit(20)
    trees = docs.select("doc_id", "text", editcount.tree_column(F.col("text")).alias("tree"))
    path = new_path(spark, "t-trees")
    trees.write.parquet(path)
    edits = queries.edits_of(F.col("doc_id"), F.col("text"))
    for r in spark.read.parquet(path).withColumn("after", editcount.edited_column(F.col("tree"), edits)).withColumn("edits", edits).collect():
        text = r["text"]
        for e in r["edits"]:
            text = text[: e["start"]] + e["text"] + text[max(e["end"], e["start"]) :] if e["start"] <= len(text) else text + e["text"]
        assert "".join(r["after"]["segments"]) == text
        assert sum(r["after"]["counts"]) == len(reference.encode(text, add_special_tokens=False).ids)
        assert r["after"]["reencoded_chars"] < 0.9 * len(text)


def test_edit_nulls(spark):
    rows = [(1, "one two three", [(0, 3, None), None]), (2, None, [(0, 0, "x")]), (3, "", None), (4, "a b", [(None, None, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", editcount.count_column(F.col("text"), F.col("edits")).alias("c")).collect()}
    assert [got[k]["chars_after"] for k in (1, 2, 3, 4)] == [10, 1, 0, 3]


def test_edit_query(spark, docs, empty, reference):
    src = table(spark, SF, "documents").select("doc_id", "text")
    edits = {r["doc_id"]: (r["text"], r["e"]) for r in src.select("doc_id", "text", queries.edits_of(F.col("doc_id"), F.col("text")).alias("e")).collect()}
    for r in queries.op9_token_counts(spark, SF).collect():
        text, own = edits[r["doc_id"]]
        assert r["tokens_before"] == len(reference.encode(text, add_special_tokens=False).ids)
        for e in own:
            text = text[: min(e["start"], len(text))] + e["text"] + text[min(e["end"], len(text)) :]
        assert r["tokens_after"] == len(reference.encode(text, add_special_tokens=False).ids) and r["chars_after"] == len(text)
    edge = editcount.with_counts(docs, queries.edits_of(F.col("doc_id"), F.col("text"))).select("doc_id", "counts.*").toPandas()
    assert len(edge) == 10 and (edge[edge["doc_id"] == 3]["tokens_after"] == 0).all()
    long = edge[edge["doc_id"] == 5].iloc[0]
    assert long["reencoded_chars"] < 0.1 * long["chars_after"]
    assert editcount.with_counts(empty, F.lit(None).cast("array<struct<start:long,end:long,text:string>>")).count() == 0


# 10

def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs):
    by = {}
    for i, fp in pairs:
        by.setdefault(fp, []).append(i)
    root = {f: f for f in by}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(by, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for f, ids in by.items():
        least[find(f)] = min([least.get(find(f), 1 << 64), *[i for i in ids if i is not None]])
    return {f: least[find(f)] for f in by}


def test_simhash(spark):
    src = pdf_of(spark)
    fps = [plain_fingerprint(t) for t in src["text"]]
    comp = plain_components(list(zip(src["doc_id"], fps)))
    want = {d: (f"{f:016x}", comp[f]) for d, f in zip(src["doc_id"], fps)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == want


def test_simhash_edges(spark, docs, empty):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == 10
    by = got.dropna(subset=["doc_id"]).groupby("doc_id")["component_id"].first()
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("large", [8, 4096])
def test_buckets_lose_no_component(large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(large)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in list(fps):
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.append(f ^ sum(1 << int(b) for b in flips))
    fps = np.array(sorted(set(fps)), np.uint64)
    links = simhash.bucket_links(fps, 4, ((0, 64),))
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    root = {int(f): int(f) for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[find(a)] = find(b)
    want = plain_components([(int(f), int(f)) for f in fps])
    mine = {}
    for f in root:
        mine.setdefault(find(f), []).append(f)
    assert {f: min(g) for g in mine.values() for f in g} == want


def test_large_buckets_are_dealt_out_again(monkeypatch):
    """A bucket whose fingerprints differ in few bits stays large after one deal; no component is lost."""
    rng = np.random.default_rng(8)
    bits = tuple(range(0, 40))
    fps = np.unique(np.bitwise_or.reduce(rng.integers(0, 2, (1500, 12)).astype(np.uint64) << np.array(bits[::4] + (1, 2), np.uint64), axis=1))
    want = {frozenset(c) for c in brute_components(fps)}
    monkeypatch.setattr(simhash, "LARGE", 20)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.bucket_links(fps, 4, bits):
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    groups = {}
    for f in fps.tolist():
        groups.setdefault(find(f), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == want


def brute_components(fps):
    left, out = {int(f) for f in fps}, []
    while left:
        queue, group = [left.pop()], set()
        while queue:
            at = queue.pop()
            group.add(at)
            near = {f for f in left if (f ^ at).bit_count() <= 4}
            left -= near
            queue += near
        out.append(group)
    return out


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# pipeline

def test_pipeline(spark):
    import corpus_pipeline as P

    docs = table(spark, SF, "documents")
    kept, frames = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, kept, SF)
        if name != "packing":
            assert out.columns == docs.columns
        path = new_path(spark, "t-pipeline")
        out.write.parquet(path)
        kept = frames[name] = spark.read.parquet(path)
    first = frames["language_id"].toPandas()
    assert len(first) >= 0.95 * docs.count()
    comp = plain_components([(d, plain_fingerprint(t)) for d, t in zip(first["doc_id"], first["text"])])
    second = {r["doc_id"] for r in frames["simhash_dedup"].collect()}
    assert second == set(comp.values())
    leaks = {r["doc_id"] for r in queries.op4_decontamination(spark, SF).collect()}
    third = {r["doc_id"] for r in frames["decontamination"].collect()}
    assert third == second - leaks
    assert {r["doc_id"] for r in frames["packing"].collect()} == third
    assert P.run(spark, SF).count() == frames["packing"].count()


def test_pipeline_edges(spark, docs, empty):
    import corpus_pipeline as P

    cols = docs.select("doc_id", "text", "lang", "source", "n_chars", "size", "hits")
    kept = P.near_duplicate_stage(spark, cols, SF)
    assert kept.columns == cols.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, None, 5, 6, 7, 8]))
    assert P.near_duplicate_stage(spark, empty, SF).count() == 0
    assert P.language_stage(spark, empty, SF).count() == 0
    assert P.decontamination_stage(spark, empty, SF).count() == 0


def test_shared_dir(spark):
    assert shared_dir(spark)
