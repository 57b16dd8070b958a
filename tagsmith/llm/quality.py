"""Operator 2: a quality classifier from weak labels.

Several heuristic labellers look at a text and say good, bad or nothing; they overlap and err. Expectation maximisation
over the counts of their joint votes, taken from all documents, estimates each one's accuracy, and with it the posterior
probability that a document with given votes is good. A linear scorer on hashed features of a bounded sample of
documents learns those posteriors, and then scores every whole text, also where the labellers are silent. Labels made
by people take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.llm.common import free_name, hashed, ship, slices, smallest_hashes, write_table

GOOD, BAD, SILENT = 1, 0, 2
#: Buckets of byte trigrams, and all.
TRIGRAMS, DIMENSIONS = 1 << 12, (1 << 12) + 512
_STEPS = (0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8)
#: Kinds of bytes: letters in either case, digits, white space, plain punctuation, other signs, parts of characters.
_LOWER, _UPPER, _DIGIT, _SPACE, _PLAIN, _SIGN, _WIDE = range(7)


def _kinds() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = _WIDE
        elif c.isalpha():
            out[b] = _LOWER if c.islower() else _UPPER
        elif c.isdigit():
            out[b] = _DIGIT
        elif c.isspace():
            out[b] = _SPACE
        elif c in ".,;:?'\"()-":
            out[b] = _PLAIN
    return out


_KIND = _kinds()


#: Frequent words of running text in English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for was on are with as at be this by from or an not "
    "der die und das in den von zu ist mit des auf dem ein eine nicht im für als auch sich "
    "le la les de des et un une du en que qui est dans pour pas au par sur il elle avec ne "
    "el los las de la y que en un una del se por con para su al lo es no".split()
)


@dataclass
class Measures:
    """What labellers and features see of a text."""

    words: int
    shares: dict[str, float]
    data: np.ndarray

    @staticmethod
    def of(text: str | None) -> Measures:
        text = text or ""
        data, words, lines = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), text.split(), text.split("\n")
        n = np.bincount(_KIND[data], minlength=7) if len(data) else np.zeros(7, np.int64)
        kinds, w = _KIND[data], max(1, len(words))
        letters = max(1, int(n[_LOWER] + n[_UPPER]))
        doubled = int(((data[1:] == data[:-1]) & (kinds[1:] >= _PLAIN) & (kinds[1:] <= _SIGN)).sum())
        shares = {
            "doubled": doubled / w,
            "signs": int(n[_SIGN]) / max(1, len(data)),
            "upper": int(n[_UPPER]) / letters,
            "distinct": len(set(words)) / w,
            "again": sum(map(str.__eq__, words, words[1:])) / w,
            "bare": sum(not any(map(str.isalnum, x)) for x in words if len(x) < 3) / w,
            "bars": sum(map(text.count, "|\u2022\u00b7\u00bb")) / w,
            "function": sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))) / w,
            "same_lines": 1 - len(set(lines)) / len(lines),
            "small": sum(map(str.islower, words)) / w,
            "lines": len(lines),
            "wide": int(n[_WIDE]) / max(1, len(data)),
        }
        return Measures(len(words), shares, data)

    def votes(self) -> list[int]:
        """One vote of each labeller."""
        out = []
        for share, least_words, bad, good in LABELLERS:
            x = self.shares[share]
            # the function words are those of languages in Latin letters: nothing is said of other scripts
            silent = self.words < least_words or (share == "same_lines" and self.shares["lines"] < 4) or (share == "function" and self.shares["wide"] > 0.3)
            out.append(SILENT if silent else BAD if bad[0] <= x <= bad[1] else GOOD if good[0] <= x <= good[1] else SILENT)
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights: roots of the shares of hashed byte trigrams, cut off so that none prevails, and hashes of which step each share above is in."""
        steps = [f"{k}:{sum(v > x for x in _STEPS)}" for k, v in self.shares.items() if k not in ("lines", "wide")]
        own = np.array([TRIGRAMS + xxhash.xxh32_intdigest(k, 2) % (DIMENSIONS - TRIGRAMS) for k in steps])
        shares = np.ones(len(own), np.float32)
        if len(self.data) < 3:
            return own, shares
        d = self.data.astype(np.uint32)
        h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
        h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(20)
        counts = np.bincount(h, minlength=TRIGRAMS)
        at = np.flatnonzero(counts)
        return np.concatenate([own, at]), np.concatenate([shares, np.minimum(0.1, np.sqrt(counts[at] / len(h))).astype(np.float32)])


#: Share it looks at, fewest words it speaks on, range that it calls bad, range that it calls good.
LABELLERS = (
    ("doubled", 1, (0.15, np.inf), (0, 0.03)),
    ("signs", 10, (0.1, 1), (0, 0.02)),
    ("upper", 5, (0.6, 1), (0, 0.12)),
    ("distinct", 30, (0, 0.25), (0.45, 1)),
    ("again", 10, (0.2, 1), (0, 0.05)),
    ("bare", 10, (0.2, 1), (0, 0.02)),
    ("bars", 4, (0.15, np.inf), (0, 0.02)),
    ("function", 20, (0, 0.04), (0.12, 1)),
    ("same_lines", 10, (0.5, 1), (0, 0.1)),
    ("small", 10, (0, 0.3), (0.75, 1)),
)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, kinds: int = 4, rounds: int = 500, smooth: float = 0.5, against: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    """votes: a row for each pattern; counts: its documents. Returns the posterior that a pattern is good, each
    labeller's accuracy where it speaks, and the prior that a document is good.

    A text fails in one way or another, and labellers for the other ways don't see it. So there is one kind of good text
    and several kinds of bad ones, each with its own P(vote | kind, labeller speaks); silence says nothing. Starts from
    the votes, where one for bad counts as much as `against` for good, and from frequent patterns of bad votes that
    differ most as the kinds."""
    bad = votes == BAD
    posterior = np.clip(((votes == GOOD).sum(1) + 1) / ((votes == GOOD).sum(1) + against * bad.sum(1) + 1.5), 0.02, 0.98)
    seeds = [int(np.argmax(counts * bad.sum(1)))]
    distance = lambda k: (bad != bad[k]).sum(1)
    while len(seeds) < kinds:
        seeds.append(int(np.argmax(np.where(bad.any(1), np.log1p(counts) * np.min([distance(k) for k in seeds], 0), 0))))
    nearest = np.argmin([distance(k) for k in seeds], 0)
    share = np.concatenate([posterior[:, None], (1 - posterior)[:, None] * np.where(nearest[:, None] == np.arange(kinds), 0.9, 0.1 / max(1, kinds - 1))], 1)
    share /= share.sum(1, keepdims=True)
    said = {v: (votes == v).astype(float) for v in (BAD, GOOD)}
    for _ in range(rounds):
        weight = share * counts[:, None]
        yes, no = weight.T @ said[GOOD] + smooth, weight.T @ said[BAD] + smooth
        prior = (weight.sum(0) + smooth) / (counts.sum() + smooth * (kinds + 1))
        log = np.log(prior) + said[GOOD] @ np.log(yes / (yes + no)).T + said[BAD] @ np.log(no / (yes + no)).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        step, share = np.abs(new - share).max(), new
        if step < 1e-9:
            break
    good, total = share[:, 0], counts[:, None] * (said[GOOD] + said[BAD])
    right = (counts[:, None] * (good[:, None] * said[GOOD] + (1 - good)[:, None] * said[BAD])).sum(0) / np.maximum(1e-12, total.sum(0))
    return good, right, float((good * counts).sum() / counts.sum())


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 1500, penalty: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model of soft labels, by mini-batch gradient steps with adaptive sizes; columns
    are scaled to unit deviation meanwhile."""
    scale = 1 / (x.std(0) + 0.05)
    x, y = (x * scale).astype(np.float32), y.astype(np.float32)
    w, b, rng = np.zeros(x.shape[1], np.float32), np.float32(0), np.random.default_rng(seed)
    square, square_b = np.full(x.shape[1], 1e-8, np.float32), np.float32(1e-8)
    for _ in range(rounds):
        at = rng.integers(0, len(x), 256)
        z = x[at]
        g = 1 / (1 + np.exp(-np.clip(z @ w + b, -50, 50))) - y[at]
        grad, grad_b = z.T @ g / len(at) + penalty * w, g.mean()
        square, square_b = square + grad**2, square_b + grad_b**2
        w -= np.float32(0.05) * grad / np.sqrt(square)
        b -= np.float32(0.05 * grad_b / np.sqrt(square_b))
    return (w * scale).astype(np.float32), float(b)


@dataclass
class QualityModel:
    """patterns: the posterior of each joint vote that occurred. accuracy: of each labeller, where it speaks."""

    weights: np.ndarray
    offset: float
    patterns: dict[str, float]
    accuracy: dict[str, float]
    prior: float

    def score(self, m: Measures) -> float:
        if not m.words:
            return 0.0
        at, x = m.features()
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at] + self.offset, -50, 50))))


def fit(df: DataFrame, sample_docs: int = 4000, text: str = "text") -> QualityModel:
    """Votes of all documents; the scorer from at most sample_docs distinct texts, the same for the same texts: those
    with the smallest hashes in the whole table, for each joint vote; a quarter of them is dealt evenly, the rest by the
    votes' numbers of texts. Texts without a word, null or not, take no part. An empty table gives a model that keeps every text with a word."""
    ship(df.sparkSession)
    body = df.select(F.col(f"`{text}`").alias("text"), hashed(F.col(f"`{text}`")).alias("h"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(m.votes(), h) for m, h in ((Measures.of(t), h) for t, h in zip(*(batch.column(c).to_pylist() for c in ("text", "h")), strict=True)) if m.words]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, v)) for v, _ in found], pa.string()), pa.array([h for _, h in found], pa.int64())], ["votes", "h"])

    voted = write_table(body.mapInArrow(vote, "votes string, h long").groupBy("votes", "h").agg(F.count("*").alias("n")), "votes")
    patterns = sorted(voted.groupBy("votes").agg(F.sum("n")).collect())  # 3 to the number of labellers at most
    if not patterns:
        return QualityModel(np.zeros(DIMENSIONS, np.float32), 1.0, {}, {}, 1.0)
    votes, counts = np.array([[int(v) for v in r.votes] for r in patterns]), np.array([r[1] for r in patterns], np.float64)
    posterior, right, prior = expectation_maximisation(votes, counts)
    of = {r.votes: float(p) for r, p in zip(patterns, posterior, strict=True)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, y, x = [], [], []
            for t, h in zip(*(batch.column(c).to_pylist() for c in ("text", "h")), strict=True):
                m = Measures.of(t)
                if m.words:
                    dense = np.zeros(DIMENSIONS, np.float32)
                    np.add.at(dense, *m.features())
                    own.append(h)
                    y.append(of["".join(map(str, m.votes()))])
                    x.append(dense.astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(y, pa.float64()), pa.array(x, pa.binary())], ["h", "y", "x"])

    chosen = df.sparkSession.createDataFrame([(h,) for _, h in smallest_hashes(voted.select(F.col("votes").alias("stratum"), "h"), sample_docs, 0.25)], "h long")
    picked = sorted(body.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("text", "h").mapInArrow(featured, "h long, y double, x binary").collect())
    x, y = np.stack([np.frombuffer(r.x, "<f2") for r in picked]).astype(np.float32), np.array([r.y for r in picked])
    weights, offset = fit_linear(x, y)
    return QualityModel(weights, offset, of, {f"{k}:{s[0]}": float(a) for k, (s, a) in enumerate(zip(LABELLERS, right, strict=True))}, prior)


def classify(df: DataFrame, model: QualityModel, threshold: float = 0.5, text: str = "text", score: str = "quality_score", kept: str = "kept") -> DataFrame:
    """df with the score (0 to 1) of each whole text and whether it is kept; columns of those names are replaced. Texts
    without a word (null, empty, blank) score 0."""
    spark = df.sparkSession
    ship(spark)
    keep = [f for f in df.schema.fields if f.name.lower() not in (score.lower(), kept.lower())]
    names, shared = [f.name for f in keep], spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [shared.value.score(Measures.of(t)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.float64()), pa.array([s >= threshold for s in found], pa.bool_())], [*names, score, kept])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType([*keep, T.StructField(score, T.DoubleType()), T.StructField(kept, T.BooleanType())]))


def keep_good(df: DataFrame, threshold: float = 0.5, sample_docs: int = 4000, text: str = "text") -> DataFrame:
    """The rows of df that a model fitted on it keeps, with the columns of df."""
    score, kept = free_name(df, "score"), free_name(df, "kept")
    return classify(df, fit(df, sample_docs, text), threshold, text, score, kept).filter(F.col(kept)).drop(score, kept)
