"""Operator 6: document fingerprints from prefix polynomial hashes.

The array of a text's prefix hashes, modulo two primes, gives the hash of any span in constant time: so it answers
whether two spans are equal, and finds the longest common extension of two positions by binary search. A fingerprint
holds the hash and length of the whole text and the smallest distinct hashes of its spans of WIDTH code points (for
short texts, of narrow spans too). How alike two fingerprints are is the share of spans that the texts have in common,
estimated from the smallest hashes of both together: 1 for equal texts, about 2/3 if a third was replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.llm.common import ship, slices, write_table

PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1812433253)
#: Code points of a span; of one in a text shorter than SHORT; hashes that are kept.
WIDTH, NARROW, SHORT, KEPT = 12, 3, 96, 64


class _Powers:
    """Powers of the bases and of their inverses, as long as the longest text so far."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        while len(self.up[0]) < n:
            for k, p in enumerate(PRIMES):
                for table, base in ((self.up, BASES[k]), (self.down, pow(BASES[k], -1, p))):
                    step = np.uint64(pow(base, len(table[k]), p))
                    table[k] = np.concatenate([table[k], table[k] * step % np.uint64(p)])

    def trim(self, most: int = 1 << 20) -> None:
        """After a very long text its powers go, as a worker lives on."""
        if len(self.up[0]) > most:
            self.up, self.down = ([x[:most].copy() for x in table] for table in (self.up, self.down))


_POWERS = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHashes:
    """at[k][i]: the hash of the first i code points modulo PRIMES[k]: the sum of (code + 1) * base ** position."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        _POWERS.grow(self.n + 1)
        c, self.at = codes.astype(np.uint64) + np.uint64(1), []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * _POWERS.up[k][: self.n] % np.uint64(p), out=sums[1:])
            self.at.append(sums % np.uint64(p))

    def spans(self, start, stop) -> np.ndarray:
        """The hashes of spans wherever they stand, both primes in one number; start and stop may be arrays."""
        out = []
        for k, p in enumerate(PRIMES):
            s = self.at[k]
            out.append((s[stop] + np.uint64(p) - s[start]) % np.uint64(p) * _POWERS.down[k][start] % np.uint64(p))
        return (out[0] << np.uint64(31)) | out[1]

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all spans of width; a shorter text is one span, an empty text has none."""
        if self.n <= width:
            return self.spans(np.zeros(1, np.int64), np.full(1, self.n)) if self.n else np.zeros(0, np.uint64)
        out = []
        for k, p in enumerate(PRIMES):
            s = self.at[k]
            out.append((s[width:] + np.uint64(p) - s[:-width]) % np.uint64(p) * _POWERS.down[k][: self.n - width + 1] % np.uint64(p))
        return (out[0] << np.uint64(31)) | out[1]

    def equal(self, start: int, other: PrefixHashes, at: int, n: int) -> bool:
        """Whether n code points from start are those of other from at."""
        return start + n <= self.n and at + n <= other.n and self.spans(start, start + n) == other.spans(at, at + n)

    def common(self, start: int, other: PrefixHashes, at: int) -> int:
        """How many code points from start on are those of other from at on."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, at, middle) else (low, middle - 1)
        return low


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread hashes over 32 bits, so that the smallest are a fair sample."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The smallest distinct of the mixed hashes, ascending."""
    x, limit = _mixed(hashes), 1 << 32
    if len(x) > 8 * kept:
        limit = (1 << 32) * 4 * kept // len(x)
    while True:
        found = np.unique(x[x < limit] if limit < 1 << 32 else x)
        if len(found) >= kept or limit >= 1 << 32:
            return found[:kept]
        limit *= 8


class Fingerprint:
    def __init__(self, whole: int, n: int, wide: np.ndarray, narrow: np.ndarray):
        self.whole, self.n, self.wide, self.narrow = whole, n, wide, narrow

    def __str__(self) -> str:
        return f"{self.whole:016x}:{self.n:x}:{self.wide.astype('>u4').tobytes().hex()}:{self.narrow.astype('>u4').tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> Fingerprint:
        whole, n, *both = text.split(":")
        return Fingerprint(int(whole, 16), int(n, 16), *(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in both))

    def likeness(self, other: Fingerprint) -> float:
        if (self.whole, self.n) == (other.whole, other.n):
            return 1.0
        a, b = (self.narrow, other.narrow) if len(self.narrow) and len(other.narrow) else (self.wide, other.wide)
        if not len(a) or not len(b):
            return 0.0
        both = np.union1d(a, b)[: max(len(a), len(b)) if max(len(a), len(b)) == KEPT else None]
        shared = np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)
        j = float(shared.sum()) / len(both)
        return 2 * j / (1 + j)


class Document:
    """A text with its prefix hashes and window hashes, each made once."""

    def __init__(self, text: str):
        self.text, self.codes = text, code_points(text)
        self.prefix = PrefixHashes(self.codes)
        self.windows = self.prefix.windows(WIDTH)
        self.fingerprint = _fingerprint(self.prefix, self.windows)

    def edited(self, other: Document) -> tuple[str, Fingerprint, PrefixHashes]:
        """The last third replaced by as much of the beginning of other; hashes of spans within either part are reused."""
        third = self.prefix.n // 3
        keep, take = self.prefix.n - third, min(third, other.prefix.n)
        codes = np.concatenate([self.codes[:keep], other.codes[:take]])
        prefix = PrefixHashes(codes)
        if keep >= WIDTH and take >= WIDTH:
            seam = PrefixHashes(codes[keep - WIDTH + 1 : keep + WIDTH - 1]).windows(WIDTH)
            windows = np.concatenate([self.windows[: keep - WIDTH + 1], seam, other.windows[: take - WIDTH + 1]])
        else:
            windows = prefix.windows(WIDTH)
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        return text, _fingerprint(prefix, windows), prefix


def _fingerprint(prefix: PrefixHashes, windows: np.ndarray) -> Fingerprint:
    whole = int(prefix.spans(np.zeros(1, np.int64), np.full(1, prefix.n))[0])
    narrow = smallest(prefix.windows(NARROW)) if prefix.n < SHORT else np.zeros(0, np.uint32)
    return Fingerprint(whole, prefix.n, smallest(windows), narrow)


def fingerprint(text: str | None) -> str:
    return str(Document(text or "").fingerprint)


def likeness(a: str, b: str) -> float:
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


def _part(column, bounds: list[int]):
    """How many of the ascending bounds are over the value: coarse steps first, then the step's bounds."""
    if not bounds:
        return F.lit(0)
    down, step = sorted(bounds, reverse=True), 64
    above = lambda xs: F.size(F.filter(xs, lambda x: x > column))
    coarse = above(F.array(*(F.lit(x) for x in down[step - 1 :: step]))) if len(down) >= step else F.lit(0)
    fine = above(F.slice(F.array(*(F.lit(x) for x in down)), coarse * step + 1, step))
    return coarse * step + fine


def fingerprint_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edit with the next document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, common_edited and common_next (code points that the text shares from the
    start with its edit and with the next text).

    The next document is the next smaller doc_id (rows without one come last, by a hash of their text and then the text,
    descending; rows of the same doc_id by text, descending); after the last comes the first, and a single row follows itself. Null text: as an empty one. Other
    columns are left out. Texts are dealt by ranges of doc_id once, and those without one by ranges of their hash; each range gets a copy of the next one's first row,
    so no task waits for another and none sees more than its range."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.filter(F.col("doc_id").isNotNull())
    n, without = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    more = math.ceil(parts * without / n) if without else 0  # ranges of rows without a doc_id
    down = F.lit(0.5) - F.xxhash64("text").cast("double") / float(1 << 64)  # 0 for the largest hash, 1 for the smallest
    rows = rows.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    bounds = sorted({int(x) for x in known.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    nameless = F.lit(len(bounds) + 1) + F.least(F.floor(down * more), F.lit(max(0, more - 1)))
    dealt = rows.withColumn("part", F.when(F.col("doc_id").isNull(), nameless).otherwise(_part(F.col("doc_id"), bounds)).cast("int"))
    heads = write_table(dealt.groupBy("part").agg(F.max(F.struct("doc_id", "h", "text")).alias("head")), "heads")
    there = sorted(r.part for r in heads.select("part").collect())
    if there:
        before = spark.createDataFrame([(p, there[i - 1]) for i, p in enumerate(there)], "part int, goes_to int")
        ghosts = heads.join(F.broadcast(before), "part").select("head.doc_id", "head.text", "head.h", F.col("goes_to").alias("part"), F.lit(True).alias("ghost"))
        dealt = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    else:
        dealt = dealt.withColumn("ghost", F.lit(False))
    # each range has a task of its own: by a hash of the part, some tasks would get several
    ordered = dealt.repartitionById(parts + more, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()).drop("h")

    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None  # doc_id, part, document
        for batch in slices(batches):
            out: list[tuple] = []
            for i, t, part, ghost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ghost")), strict=True):
                doc = Document(t)
                if here is not None and here[1] == part:
                    out.append(_compared(here[0], here[2], doc))
                here = None if ghost else (i, part, doc)
                _POWERS.trim()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")


def _compared(doc_id: int | None, doc: Document, following: Document) -> tuple:
    text, own, prefix = doc.edited(following)
    return (
        doc_id, doc.prefix.n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), str(doc.fingerprint), str(own),
        doc.fingerprint.likeness(own), doc.fingerprint.likeness(following.fingerprint),
        doc.prefix.common(0, prefix, 0), doc.prefix.common(0, following.prefix, 0),
    )
