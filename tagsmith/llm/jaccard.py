"""Operator 9: join of near-duplicate texts by Jaccard similarity of word shingles, with Bayesian candidate pruning.

1. Each text becomes a sketch: a digest of its set of shingles and 96 MinHash values of 16 bits, in 24 bands of 4.
   Texts with equal sets are one class of copies; only its representative goes on.
2. Representatives that agree in a band meet. Their MinHash values are compared some at a time; a pair is dropped as
   soon as the posterior probability that its similarity reaches the threshold (uniform prior; Beta posterior) falls
   below a tolerance. What is left connects representatives to clusters.
3. Within a cluster all pairs that agree in a band and pass the same test are verified exactly on their shingle sets.
   The links are counted for each representative; the links that hold make up the classes.

A bucket or cluster of any size is cut into blocks, and each pair of blocks is a group of its own, so that no task gets
more than two blocks. No step writes a row for each pair: the pruning writes a spanning forest, the verification counts.
A pair of similarity 0.8 shares no band with probability 3e-6, and is pruned wrongly with about the tolerance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.llm.common import free_name, likely, ship, slices, write_table
from tagsmith.llm.components import connected_components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: MinHash values compared before each look at the posterior.
STEPS = (16, 32, 64, 96)
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The set of hashes of width consecutive words, sorted. Words are runs of letters, digits and underscores, in
    lower case. Fewer words make one shingle; no words none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    n = min(width, len(words))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = (s ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(31)))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, as 16 bits each."""
    least = np.full(HASHES, ~np.uint64(0))
    for i in range(0, len(s), 1024):
        np.minimum(least, (_A[:, None] * s[None, i : i + 1024] + _B[:, None]).min(1), out=least)
    return ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.uint16)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each of STEPS the fewest equal values with which a pair may go on: those for which the posterior probability
    that the similarity is the threshold at least is the tolerance at least. It is P(Bin(n + 1, threshold) <= m)."""
    out = []
    for n in STEPS:
        p, total = [math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)], 0.0
        for m in range(n + 1):
            total += p[m]
            if total >= tolerance:
                out.append(m)
                break
    return tuple(out)


def prune(values: np.ndarray, i: np.ndarray, j: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs (i, j) of rows of MinHash values pass all looks at the posterior."""
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in zip(STEPS, limits, strict=True):
        now = np.concatenate([(values[i[a], done:n] == values[j[a], done:n]).sum(1) for a in np.array_split(alive, len(alive) // 50_000 + 1)])
        matches = matches + now
        ok = matches >= least
        alive, matches, done = alive[ok], matches[ok], n
    return alive


def _agree(bands: np.ndarray, left: np.ndarray, right: np.ndarray, before: int) -> np.ndarray:
    """A matrix: whether the rows left and right agree in a band before the given one."""
    out = np.zeros((len(left), len(right)), bool)
    for k in range(before):
        out |= bands[left, k][:, None] == bands[right, k][None, :]
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, was[i], low)
        np.minimum.at(root, was[j], low)
        root = root[root]
        if (root == was).all():
            break
    return root


def _pairs(blocks: np.ndarray, bi: int, bj: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Stripes of the pairs of two blocks, or within one: left rows, right rows, whether only left < right counts."""
    left, right = np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)
    for k in range(0, len(left), step):
        yield left[k : k + step], right, bi == bj


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(at):
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])])
            held = []
        held.append(batch.slice(at[-1] if len(at) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _sigs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _texts(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    own = F.col(f"`{text}`")
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("h"), own.alias("text"))


def sketches(df: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """row, doc_id, h (hash of the text), n (shingles), d1 and d2 (digest of the set; of the text, if it has no word), sig."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, d1, d2, sig = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, width)
                a, b = digest(s) if len(s) else _digest_of(b"no words:" + (t or "").encode("utf-8", "surrogatepass"))
                n.append(len(s))
                d1.append(a)
                d2.append(b)
                sig.append(signature(s).astype("<u2").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "h")), *(pa.array(x, k) for x, (_, k) in zip((n, d1, d2, sig), fields[3:], strict=True))], [f for f, _ in fields])

    rows = _texts(df, text, doc_id).select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "text")
    return write_table(rows.mapInArrow(run, "row long, doc_id long, h long, n long, d1 long, d2 long, sig binary"), "sketches")


def digest(s: np.ndarray) -> tuple[int, int]:
    return _digest_of(s.astype("<u8").tobytes())


def _digest_of(data: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(data), "<i8")
    return int(a), int(b)


def candidate_edges(reps: DataFrame, limits: tuple[int, ...], block: int) -> DataFrame:
    """A spanning forest of the pairs of representatives that agree in a band and aren't pruned: a, b."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.hex(F.substring("sig", k * 2 * ROWS + 1, F.lit(2 * ROWS))))
    rows = reps.select("rep", F.posexplode(keys).alias("band", "hex")).select("rep", "band", F.conv("hex", 16, -10).cast("long").alias("key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).filter("m >= 2")
    members = rows.join(shared, ["band", "key"]).select("rep", "band", "key", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    members = _blocks(members, ["band", "key"]).join(reps.select("rep", "sig"), "rep")
    groups = ["band", "key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, groups):
            band, key, bi, bj, block_of, rep = (table.column(c).to_numpy() for c in (*groups, "block", "rep"))
            values = _sigs(table.column("sig"))
            bands = np.ascontiguousarray(values).view("<i8")
            start = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            size = np.diff(np.r_[start, len(band)])
            two = start[(size == 2) & (bi[start] == bj[start])]
            first = np.ones(len(two), bool)
            for k in range(BANDS):
                first &= (k >= band[two]) | (bands[two, k] != bands[two + 1, k])
            two = two[first]
            ok = two[prune(values, two, two + 1, limits)]
            a, b = [rep[ok]], [rep[ok + 1]]
            for s, n in zip(start, size, strict=True):
                if n < 2 or (n == 2 and bi[s] == bj[s]):
                    continue
                i, j = [], []
                for left, right, within in _pairs(block_of[s : s + n], bi[s], bj[s]):
                    new = ~_agree(bands[s : s + n], left, right, band[s])
                    if within:
                        new &= left[:, None] < right[None, :]
                    x, y = np.nonzero(new)
                    alive = prune(values[s : s + n], left[x], right[y], limits)
                    i.append(left[x[alive]])
                    j.append(right[y[alive]])
                root = _roots(n, np.concatenate(i), np.concatenate(j)) if i else np.arange(n)
                moved = np.flatnonzero(root != np.arange(n))
                a.append(rep[s + moved])
                b.append(rep[s + root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return _spread(members, groups).mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, keys: list[str]) -> DataFrame:
    """A copy of each member for each pair of blocks that its own (block) is in: bi <= bj."""
    own = members.withColumn("block", F.pmod(F.xxhash64("rep", *keys), F.col("nb")).cast("int"))
    pairs = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return pairs.withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o")).drop("o", "nb")


def _spread(rows: DataFrame, groups: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *groups).sortWithinPartitions(*groups)


def verified(df: DataFrame, members: DataFrame, threshold: float, limits: tuple[int, ...], width: int, text: str, doc_id: str) -> DataFrame:
    """members: rep, rep_doc, h, d1, d2, sig, cluster, nb. Returns rep, links, root and nb: how many representatives its
    block pair has that it links with, and the smallest that it hangs together with in it."""
    own = members.withColumnsRenamed({"rep_doc": "own_doc", "h": "own_h"})
    rows = likely(_texts(df, text, doc_id), ["doc_id", "h"], members.select(F.col("rep_doc").alias("doc_id"), "h"))
    texts = rows.join(own, rows.doc_id.eqNullSafe(own.own_doc) & (rows.h == own.own_h)).select("text", "rep", "d1", "d2", "sig", "cluster", "nb")
    names = ["rep", "sig", "cluster", "nb"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            same = [digest(s) == d for s, d in zip(sets, zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True), strict=True)]
            raw = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), raw], [*names, "shingles"]).filter(pa.array(same, pa.bool_()))

    sets = texts.mapInArrow(hashed, "rep long, sig binary, cluster long, nb int, shingles binary")
    groups = ["cluster", "bi", "bj"]
    dealt = _blocks(sets.withColumn("many", F.col("nb")), ["cluster"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, groups):
            ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in groups])
            start = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(0)])
            for s, e in zip(start, np.r_[start[1:], table.num_rows], strict=True):
                part = table.slice(s, e - s)
                rep, one = np.unique(part.column("rep").to_numpy(), return_index=True)  # repeated rows give one set
                part = part.take(pa.array(one))
                sets = [np.frombuffer(x, "<u8") for x in part.column("shingles").to_pylist()]
                values = _sigs(part.column("sig"))
                i, j = _links(sets, values, part.column("block").to_numpy(), ids[1, s], ids[2, s], threshold, limits)
                links, root = np.bincount(np.r_[i, j].astype(np.int64), minlength=len(rep)), _roots(len(rep), i, j)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(rep[root]), part.column("many").combine_chunks()], ["rep", "links", "root", "nb"])

    return _spread(dealt, groups).mapInArrow(run, "rep long, links long, root long, nb int")


def _links(sets: list[np.ndarray], values: np.ndarray, blocks: np.ndarray, bi: int, bj: int, threshold: float, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the two blocks that agree in a band, pass the pruning and reach the threshold exactly."""
    bands = np.ascontiguousarray(values).view("<i8")
    sizes = np.array([len(s) for s in sets], np.int64)
    index = None
    out_i, out_j = [], []
    for left, right, within in _pairs(blocks, bi, bj):
        met = _agree(bands, left, right, BANDS)
        if within:
            met &= left[:, None] < right[None, :]
        x, y = np.nonzero(met)
        alive = prune(values, left[x], right[y], limits)
        x, y = x[alive], y[alive]
        for k, n in zip(*np.unique(x, return_counts=True), strict=True):
            own, others = left[k], right[y[x == k]]
            if n > 16:  # from all sets of the other block at once
                if index is None:
                    all_s, owner = np.concatenate([sets[r] for r in right]), np.repeat(np.arange(len(right)), sizes[right])
                    order = np.argsort(all_s, kind="stable")
                    index = (all_s[order], owner[order])
                lo, hi = np.searchsorted(index[0], sets[own], "left"), np.searchsorted(index[0], sets[own], "right")
                ends = np.cumsum(hi - lo)
                hits = index[1][np.arange(ends[-1]) + np.repeat(lo - (ends - (hi - lo)), hi - lo)]
                common = np.bincount(hits, minlength=len(right))[y[x == k]]
            else:
                common = np.array([_common(sets[own], sets[o]) for o in others])
            ok = common >= threshold * (sizes[own] + sizes[others] - common) - 1e-9
            out_i.append(np.full(int(ok.sum()), own))
            out_j.append(others[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def near_duplicates(df: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-7, block: int = 512, block_bytes: int = 16 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, class_id, copy_of, n_links, kept, n_shingles.

    Two texts link if the Jaccard similarity of their sets of shingles (width consecutive words; fewer words are one
    shingle) is the threshold at least. class_id is the smallest doc_id of all texts that links connect; copy_of the
    smallest doc_id with the same set; n_links counts the different sets that its own links with. In each class the row
    of the smallest doc_id is kept; rows without a doc_id come after all others, and of rows that tie one is kept. Texts
    without a word link with nothing, but equal ones are copies, null and empty among them. Other columns are left out.
    An empty table gives no rows."""
    ship(df.sparkSession)
    limits = least_matches(threshold, tolerance)
    sk = sketches(df, width, text, doc_id)
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("h"))
    reps = sk.groupBy("d1", "d2").agg(F.min(who).alias("best"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = write_table(reps.select(F.col("best.row").alias("rep"), F.col("best.doc_id").alias("rep_doc"), F.col("best.h").alias("h"), "d1", "d2", "n", "sig"), "representatives")
    clusters = connected_components(candidate_edges(reps.filter("n > 0"), limits, block)).withColumnsRenamed({"node": "rep", "root": "cluster"})
    members = write_table(clusters.join(reps, "rep"), "clusters")
    loads = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(8 * F.sum("n") / F.lit(block_bytes))).cast("int").alias("nb"))
    found = write_table(verified(df, members.join(loads, "cluster"), threshold, limits, width, text, doc_id), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = found.filter("nb = 1").select("rep", "root")
    split = found.filter("nb > 1").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    joined = whole if split.isEmpty() else whole.unionByName(connected_components(split).select(F.col("node").alias("rep"), "root"))
    classes = reps.select("rep", "rep_doc", "d1", "d2").join(joined, "rep", "left").join(links, "rep", "left")
    classes = classes.withColumn("root", F.coalesce("root", "rep")).fillna(0, ["links"])
    best = F.struct(F.col("rep_doc").isNull().alias("none"), F.col("rep_doc"), F.col("rep"))
    heads = classes.groupBy("root").agg(F.min(best).alias("head"))
    classes = write_table(classes.join(heads, "root").select("rep", "rep_doc", "d1", "d2", "links", F.col("head.rep_doc").alias("class_doc"), F.col("head.rep").alias("class_row")), "classes")
    rows = sk.select("row", "doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "rep_doc", "links", "class_doc", "class_row"), ["d1", "d2"])
    return rows.select("doc_id", F.col("class_doc").alias("class_id"), F.col("rep_doc").alias("copy_of"), F.col("links").cast("long").alias("n_links"), (F.col("row") == F.col("class_row")).alias("kept"), F.col("n").alias("n_shingles"))


def drop_near_duplicates(df: DataFrame, threshold: float = 0.8, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df but one of each class of near-duplicates, with the columns of df. Rows are told by doc_id: rows
    that share one stay or go together, and rows without one stay."""
    dropped = near_duplicates(df, threshold, width, text=text, doc_id=doc_id).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    name = free_name(df, "dropped")
    return df.join(dropped.select(F.col("doc_id").alias(name)), F.col(f"`{doc_id}`").cast("long") == F.col(name), "left_anti")
