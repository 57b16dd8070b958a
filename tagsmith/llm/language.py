"""Operator 3: language identification.

A text's letters, in lower case, give hashed n-grams of one to four code points, with word ends. A text is the average of
its n-grams' embeddings; a linear softmax on it gives the language. Both are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows and on short cuts from them, so that short texts are known too. A
temperature and a rejection threshold are then fitted on labelled rows that were kept out. As the average and the last
layer are linear, prediction only averages one row of logits for each n-gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.llm.common import hashed, ship, slices, smallest_hashes, write_table

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


_LETTERS = _is_letter()


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a text; none if it has no letter."""
    if not text or not _LETTER.search(text):
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where((c >= 0x10000) | _LETTERS[np.minimum(c, 0xFFFF)], c, 32)
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    out = []
    for n in ORDERS:
        h = np.full(len(c) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ (c[k : len(c) - n + 1 + k] * _ODD[k])) * np.uint32(0x5BD1E995)
        h ^= h >> np.uint32(15)
        out.append((h[c[: len(h)] != 32] if n == 1 else h) & np.uint32(BUCKETS - 1))
        if len(c) <= n:
            break
    return np.concatenate(out).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 3, is 1. No id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray
    offset: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        at = ngrams(text)
        if not len(at) or not self.languages:
            return "und", 0.0
        z = self.logits[at].mean(0) + self.offset
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 6, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """rows: distinct buckets and their shares. One row a step; the rate falls to 0; classes weigh the same. Returns the
    logits of each bucket and the offset."""
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, classes)).astype(np.float32), np.zeros(classes, np.float32)
    weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=classes)) / classes
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, share = rows[k]
            own = e[at]
            h = share @ own
            g = _softmax(h @ w + b)
            g[labels[k]] -= 1
            g *= rate * (1 - done / steps) * min(5.0, weight[labels[k]])
            e[at] = own - (share * min(50.0, 1 / share.max()))[:, None] * (w @ g)[None, :] * 0.2
            w -= np.outer(h, g)
            b -= 0.05 * g
            done += 1
    return e @ w, b


def fit(df: DataFrame, sample_docs: int = 3000, cuts: int = 2, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", reject_error: float = 0.01) -> LanguageModel:
    """Learn from at most sample_docs distinct texts with letters, a lang, and an id that isn't held out; cuts is
    the number of short cuts from each. They are those with the smallest hashes in the whole table, for each language:
    half of them dealt evenly, half by the languages' sizes. One in five of them is for calibration: the temperature makes their likelihood
    largest, and reject_below is the lowest score over which at most reject_error of them are wrong."""
    ship(df.sparkSession)
    usable = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{doc_id}`").alias("doc_id")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", F.col("lang").alias("stratum"), hashed(F.col("text")).alias("h"))
    picked = smallest_hashes(write_table(usable.select("stratum", "h").distinct(), "languages"), sample_docs, 0.5)
    chosen = df.sparkSession.createDataFrame(picked, "stratum string, h long")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t, label, h in zip(*(batch.column(c).to_pylist() for c in ("text", "stratum", "h")), strict=True):
                rng = np.random.default_rng(len(t))
                parts = [t, *(t[s : s + int(rng.integers(8, 120))] for s in rng.integers(0, max(1, len(t) - 8), cuts))]
                for k, part in enumerate(parts):
                    at = ngrams(part)
                    if len(at):
                        b, c = np.unique(at, return_counts=True)
                        out.append((label, h, k, b.astype("<u2").tobytes(), (c / len(at)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "h", "k", "at", "share"])

    found = usable.join(F.broadcast(chosen), ["stratum", "h"]).dropDuplicates(["stratum", "h"]).select("text", "stratum", "h").mapInArrow(featured, "lang string, h long, k long, at binary, share binary").collect()
    found.sort(key=lambda r: (r.h, r.lang, r.k))
    languages = sorted({r.lang for r in found})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rows = [(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.share, "<f4")) for r in found]
    labels = np.array([languages.index(r.lang) for r in found])
    number = {own: i for i, own in enumerate(dict.fromkeys((r.h, r.lang) for r in found))}
    test = np.array([number[r.h, r.lang] % 5 == 4 for r in found])  # a text and its cuts are on one side
    own = [r for r, t in zip(rows, test, strict=True) if not t]
    logits, offset = train(own or rows, labels[~test] if own else labels, len(languages))
    model = LanguageModel(languages, logits, offset)
    if test.any():
        z = np.stack([share @ logits[at] + offset for (at, share), t in zip(rows, test, strict=True) if t])
        truth = labels[test]
        loss = {t: -np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(z)), truth])).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        best = np.argsort(-p.max(1), kind="stable")
        wrong = np.cumsum(p.argmax(1)[best] != truth[best]) / np.arange(1, len(best) + 1)
        ok = np.flatnonzero(wrong <= reject_error)
        model.reject_below = float(p.max(1)[best[ok[-1]]]) if len(ok) else 1.0
    return model


def identify(df: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred", score: str = "score", accepted: str = "accepted") -> DataFrame:
    """df with the language of each whole text, its calibrated probability, and whether that reaches the threshold;
    columns of those names are replaced. Null texts and texts without a letter are `und`, score 0, not accepted; so are
    all if nothing was learned."""
    spark = df.sparkSession
    ship(spark)
    new = [language, score, accepted]
    keep = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in new}]
    names, shared = [f.name for f in keep], spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            found = [m.predict(t) for t in batch.column(text).to_pylist()]
            columns = (pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64()), pa.array([a != "und" and b >= m.reject_below for a, b in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *new])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType([*keep, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(accepted, T.BooleanType())]))
