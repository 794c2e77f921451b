"""Language identification with a convolutional network over bytes, trained in numpy.

A window of ``WINDOW`` UTF-8 bytes is embedded, convolved with filters of several widths, max-pooled
over its positions and classified by a softmax layer. A text is cut into windows that cover all of
it; its log probabilities are the mean over its windows.

Edge cases: a null text, or one without any letter (numerals are none), is ``und`` with score 0. A text shorter
than a window is padded with zero bytes; of a very long one every window counts. Without any labelled row every text is ``und``. Ties between
languages go to the alphabetically first. Other columns pass through; ones
named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
EMBED = 8
#: Bounds of the training sample: rows of a language, rows of all languages, windows of a row (spread over its whole text).
SAMPLE_ROWS = 1200
SAMPLE_ALL = 40_000
SAMPLE_WINDOWS = 16
STEPS = 500
BATCH = 96
_GROUP = 64  # windows that are convolved at once


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # (max width * EMBED) x filters
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-activation of each position, and the rows they were made of."""
        span = max(WIDTHS)
        e = np.ascontiguousarray(self.embed[windows])
        n, length = windows.shape
        step = EMBED * 4
        rows = np.lib.stride_tricks.as_strided(e, (n, length - span + 1, span * EMBED), (length * step, step, 4))
        rows = np.ascontiguousarray(rows).reshape(-1, span * EMBED)
        return (rows @ self.kernel).reshape(n, length - span + 1, -1), rows

    def logits(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(windows)[0].max(axis=1) + self.bias, 0)
        return top @ self.dense + self.offset

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.logits(windows[i : i + _GROUP]) for i in range(0, len(windows), _GROUP)])
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as ``½`` or ``Ⅷ`` are none."""
    return any(map(str.isalpha, text))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover every byte of each text, and the number of windows of each text."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    sizes = np.array([max(len(t), WINDOW) for t in texts])
    joined = np.frombuffer(b"".join(t if len(t) >= WINDOW else t.ljust(WINDOW, b"\0") for t in texts), dtype=np.uint8)
    base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base + np.minimum(nth * WINDOW, np.repeat(sizes, counts) - WINDOW)  # the last one ends with the text
    return np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[start], counts


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    span, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((span, EMBED, total), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(span * EMBED, total)
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    m = Model(langs, normal(256, EMBED, scale=0.5), normal(span * EMBED, total, scale=0.2) * mask, np.zeros(total, np.float32), normal(total, len(langs), scale=0.1), np.zeros(len(langs), np.float32))
    state = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in ("embed", "kernel", "bias", "dense", "offset")}
    groups = [np.flatnonzero(labels == k) for k in range(len(langs))]
    groups = [g for g in groups if len(g)]
    for step in range(1, STEPS + 1):
        pick = np.array([g[rng.integers(len(g))] for g in (groups[k] for k in rng.integers(0, len(groups), BATCH))])  # each language counts alike
        x, y = windows[pick], labels[pick]
        act, rows = m.pooled(x)
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None, :], 1)[:, 0] + m.bias
        hidden = np.maximum(top, 0)
        z = hidden @ m.dense + m.offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        up = (p @ m.dense.T) * (top > 0)
        won = rows.reshape(BATCH, -1, span * EMBED)[np.arange(BATCH)[:, None], at]  # batch x filters x span*EMBED
        grad = {"dense": hidden.T @ p, "offset": p.sum(0), "bias": up.sum(0), "kernel": np.einsum("bfk,bf->kf", won, up) * mask}
        back = (up[:, :, None] * m.kernel.T[None]).reshape(BATCH, total, span, EMBED)
        bytes_at = x[np.arange(BATCH)[:, None, None], at[:, :, None] + np.arange(span)]
        grad["embed"] = np.zeros_like(m.embed)
        np.add.at(grad["embed"], bytes_at.ravel(), back.reshape(-1, EMBED))
        rate = 0.01 * (1 - 0.9 * step / STEPS)
        for k, g in grad.items():
            first, second = state[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            setattr(m, k, (getattr(m, k) - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return m


def _sampled_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf[[has_letter(t) for t in pdf["text"]]]
        if len(pdf):
            windows, counts = windows_of([t.encode("utf-8", "replace") for t in pdf["text"]])
            ends = np.cumsum(counts)
            picked, lang = [], []
            for first, n, name in zip(ends - counts, counts, pdf["lang"]):
                for j in range(min(n, SAMPLE_WINDOWS)):
                    picked.append(windows[first + j * n // SAMPLE_WINDOWS if n > SAMPLE_WINDOWS else first + j].tobytes())
                    lang.append(name)
            yield pd.DataFrame({"lang": lang, "bytes": picked})


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on a bounded sample of every language: about SAMPLE_ROWS rows of each, and 1.3 * SAMPLE_ALL in all at most.

    Rows are picked by a hash of their id and text, so that the sample does not depend on the order of
    rows; only copies of one row beyond the bound are cut in no fixed order.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row of each language
    if not counts:
        return None
    most = max(1, min(SAMPLE_ROWS, SAMPLE_ALL // len(counts)))
    share = spark.createDataFrame([(k, min(1.0, 1.15 * most / n + 30 / n)) for k, n in counts.items()], "lang string, share double")
    hashed = F.xxhash64(F.lit("langid"), F.col("id"), F.col("text")).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000))
    picked = rows.withColumn("hash", hashed).join(F.broadcast(share), "lang").where("hash < share").select("lang", "text")
    bound = int(1.3 * most + 60) * len(counts) * SAMPLE_WINDOWS
    got = picked.mapInPandas(_sampled_windows, "lang string, bytes binary").limit(bound).toPandas().sort_values(["lang", "bytes"], kind="stable")
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    windows = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(langs, got["lang"].to_numpy(str)), langs)


def predict_column(model: Model | None, text: Column) -> Column:
    """struct(lang, score) of each whole text."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model is not None and t is not None and has_letter(t)]
            for part in _by_size(known, texts):
                windows, counts = windows_of([texts.iloc[i].encode("utf-8", "replace") for i in part])
                mean = np.add.reduceat(model.log_probabilities(windows), np.cumsum(counts) - counts) / counts[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang[part], score[part] = np.array(model.langs, dtype=object)[best], p.max(axis=1)
            yield pd.DataFrame({"lang": lang, "score": score})
        trim()

    return predict(text)


def _by_size(rows: list[int], texts: pd.Series, most: int = 4_000_000) -> Iterator[list[int]]:
    """Runs of rows of about ``most`` characters, so that memory does not grow with the batch."""
    part: list[int] = []
    size = 0
    for i in rows:
        part.append(i)
        size += len(texts.iloc[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of each whole text."""
    out = docs.withColumn("__lang", predict_column(model, F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("__lang.lang"), "score": F.col("__lang.score")}).drop("__lang")
