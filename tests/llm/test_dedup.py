"""Line dedup, near-duplicates and exact dedup against brute force, with awkward rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsmith.llm import common, exact_dedup, jaccard, line_dedup
from tagsmith.llm.components import connected_components
from tagsmith.llm.cuckoo import CuckooFilter, Full
from tagsmith.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(agree, name):
    assert agree(QUERIES[name], ORACLES[name]) > 0


def frame(spark, rows):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(a, b, 1, "x", None) for a, b in rows], "doc_id long, text string, n_lines int, `row` string, digest string").repartition(3)


# --- lines


def dedup_by_hand(rows, min_chars=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.setdefault(i, []).append((None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return {i: sorted(x, key=str) for i, x in out.items()}


def line_rows(seed=1):
    rng = random.Random(seed)
    pool = ["A common Line here", " a COMMON line HERE\t", "short", "", "ÄÖÜ äöü one two", "äöü äöü one two", "\x1cnot stripped here", "x" * 5000, "line with \r inside", "another line of text"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 6)) + [f"own line {i} of this"])) for i in range(40)]
    return [*rows, (50, None), (51, ""), (52, "\n\n"), (3, "A common Line here\nsecond row of three"), (None, "a common line here"), (60, "repeat me, please\nrepeat me, please")]


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    return {i: sorted(x, key=str) for i, x in out.items()}


@pytest.mark.parametrize("small", [32 << 20, 0])
def test_lines(spark, small):
    rows = line_rows()
    df = frame(spark, rows)
    out = line_dedup.dedup_lines(df, small=small, shards=4)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "n_dropped", "row", "digest"}
    assert got(out) == dedup_by_hand(rows)


def test_lines_are_reversible(spark):
    rows = [r for r in line_rows() if r[0] is not None]
    a, b = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    index = line_dedup.LineIndex.empty(spark, shards=3).insert(frame(spark, a)).insert(frame(spark, b)).insert(frame(spark, b))
    assert got(index.dedup(frame(spark, rows))) == dedup_by_hand(rows)
    gone = index.delete(spark.createDataFrame([(r[0],) for r in a] + [(12345,)], "doc_id long"))
    assert got(gone.dedup(frame(spark, b))) == dedup_by_hand(b)
    counts = lambda i: sorted(tuple(r) for r in i.counts.collect())
    assert counts(gone) == counts(line_dedup.LineIndex.empty(spark, shards=3).insert(frame(spark, b)))
    assert counts(gone.insert(frame(spark, a))) == counts(index)
    assert got(gone.insert(frame(spark, a)).dedup(frame(spark, rows))) == dedup_by_hand(rows)


def test_cuckoo():
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 1 << 64, 20_000, dtype=np.uint64) for _ in range(2))
    f = CuckooFilter.for_keys(20_000)
    f.insert(h1, h2)
    assert f.contains(h1, h2).all()
    other = rng.integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    assert f.contains(*other).mean() < 0.001
    f.delete(h1[:9000], h2[:9000])
    assert f.contains(h1[9000:], h2[9000:]).all() and f.contains(h1[:9000], h2[:9000]).mean() < 0.001
    g = CuckooFilter.from_bytes(f.to_bytes())
    g.delete(h1[9000:], h2[9000:])
    assert not g.table.any()
    with pytest.raises(KeyError):
        g.delete(h1[:1], h2[:1])
    with pytest.raises(Full):
        CuckooFilter(4).insert(h1[:100], h2[:100])


def test_full_filters_are_rebuilt(spark):
    rows = [(i, f"line number {k} is shared by all\n" * 2) for k in range(300) for i in (2 * k, 2 * k + 1)]
    index = line_dedup.LineIndex.empty(spark, shards=1).insert(frame(spark, rows[:20])).insert(frame(spark, rows[20:]))
    assert got(index.dedup(frame(spark, rows))) == dedup_by_hand(rows)


def test_shards_follow_the_number_of_keys(spark):
    rows = [(i, f"line number {k} is shared by all\n" * 2) for k in range(300) for i in (2 * k, 2 * k + 1)]
    few = line_dedup.LineIndex.empty(spark, shard_keys=20).insert(frame(spark, rows[:20]))
    many = few.insert(frame(spark, rows[20:]))
    assert (few.shards, many.shards) == (1, 16) and many.filters.count() == 16
    assert got(many.dedup(frame(spark, rows))) == dedup_by_hand(rows)
    gone = many.delete(spark.createDataFrame([(r[0],) for r in rows if r[0] % 2], "doc_id long"))
    assert gone.shards == 16 and got(gone.dedup(frame(spark, rows[::2]))) == dedup_by_hand(rows[::2])


# --- near-duplicates


def sets_by_hand(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near_by_hand(rows):
    """class and number of links of each row; equal texts without words are copies."""
    sets = [sets_by_hand(t) or frozenset([("", t or "")]) for _, t in rows]
    parent, links = list(range(len(rows))), [set() for _ in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
            if sets[a] != sets[b]:
                links[a].add(sets[b])
                links[b].add(sets[a])
    return [find(i) for i in range(len(rows))], [len(x) for x in links]


def near_rows(seed=3, n=12, copies=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        base = rng.choices(words, k=rng.choice((3, 30, 200)))
        for c in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own) + ("." if c % 3 else ""))
    rows += ["", "", None, "!!!", "!!!", "one", "One.", "one two", " "]
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("block", "block_bytes"), [(1024, 32 << 20), (3, 1 << 12)])
def test_near(spark, block, block_bytes):
    rows = sorted(near_rows(), key=lambda r: r[0])
    classes, links = near_by_hand(rows)
    out = {r.doc_id: r for r in jaccard.near_duplicates(frame(spark, rows), block=block, block_bytes=block_bytes).collect()}
    for (i, _), c, k in zip(rows, classes, links, strict=True):
        assert (out[i].class_id, out[i].n_links, out[i].kept) == (rows[c][0], k, rows[c][0] == i), i
    kept = jaccard.drop_near_duplicates(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[c][0] for c in classes})
    assert kept.columns == frame(spark, rows).columns


def test_near_repeated_and_missing_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, "p q r s t u v"), (7, "quite another text, with other words")]
    out = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert out == sorted([("5", "5", True), ("5", "5", False), ("None", "5", False), ("None", "None", True), ("7", "7", True)])


def test_near_many_rows_without_an_id(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in (0, 39) for _ in range(30)] + [(None, None), (None, ""), (4, " ".join(base))]
    out = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sum(r.kept for r in out) == 2 and len(out) == len(rows)  # null and empty are copies
    # two texts of 36 shingles, 35 of them of the whole and 34 of each other
    assert {(r.class_id, r.n_links) for r in out if r.n_shingles} == {(4, 2)} and {r.n_links for r in out if not r.n_shingles} == {0}


def test_likely_keeps_all_that_are_wanted_and_few_others(spark):
    df = spark.range(50_000).select((F.col("id") - 25_000).alias("k"), F.lit(None).cast("string").alias("bits"), F.col("id").cast("string").alias("x"))
    for wanted in (df.limit(0).select("k", "x"), df.filter("k % 50 = 0").select("k", "x"), df.filter("k = 7").select("k", F.lit(None).cast("string").alias("x"))):
        rows = df.withColumn("x", F.when(F.col("k") != 7, F.col("x")))
        found, there = common.likely(rows, ["k", "x"], wanted), wanted.count()
        assert found.columns == df.columns and there <= found.count() <= 1.05 * there + 1
        assert wanted.join(found, wanted.k.eqNullSafe(found.k) & wanted.x.eqNullSafe(found.x), "left_anti").filter("k != 7 OR x IS NULL").count() == 0
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()


def test_near_texts_move_only_if_they_may_match(spark):
    rows = near_rows()
    plan = []
    was = jaccard.likely
    jaccard.likely = lambda df, keys, wanted: plan.append((df.count(), (out := was(df, keys, wanted)).count())) or out
    try:
        jaccard.near_duplicates(frame(spark, rows + [(5000 + i, " ".join(f"u{i}x{k}" for k in range(20))) for i in range(500)])).collect()
    finally:
        jaccard.likely = was
    assert plan[0][0] == len(rows) + 500 and plan[0][1] <= len(rows)


def test_pruning_keeps_what_can_still_reach_the_threshold():
    limits = jaccard.least_matches(0.8, 1e-7)
    assert all(0 < m < n for m, n in zip(limits, jaccard.STEPS, strict=True)) and list(limits) == sorted(limits)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (400, jaccard.HASHES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < np.where(np.arange(400) < 200, 0.82, 0.2)[:, None], a, a + 1)
    alive = jaccard.prune(np.concatenate([a, b]), np.arange(400), np.arange(400, 800), limits)
    assert set(range(200)) <= set(alive) and len(alive) < 210


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got_ = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got_ == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


# --- exact copies


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact(spark, keep, fan_in):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (102, " "), (103, "x" * 100_000), (103, "x" * 100_000), (None, "text 1"), (None, "alone")]
    out = exact_dedup.exact_dedup(frame(spark, rows), keep=keep, fan_in=fan_in).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    import hashlib

    for t, ids in groups.items():
        own = [r for r in out if bytes(r.text_sha256) == hashlib.sha256(t.encode()).digest()]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in own} == {(best, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [best]


def test_exact_runs_are_made_where_the_rows_are(spark):
    """Nothing is exchanged before a run is written, and no row holds more than one member."""
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string").repartition(7)
    runs = exact_dedup.first_runs(df, 4, "text", "doc_id")
    assert runs.count() == 3000 and not [f for f in runs.schema.fields if f.dataType.typeName() == "array"]
    assert exact_dedup.heads(runs, True).groupBy("digest").count().agg({"count": "max"}).first()[0] <= 7
    out = exact_dedup.exact_dedup(df).collect()
    assert len(out) == 3000 and {(r.keep_id, r.group_size) for r in out if r.doc_id % 3} == {(2999, 2000)} and sum(r.kept for r in out) == 1001


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert line_dedup.dedup_lines(empty).count() == jaccard.near_duplicates(empty).count() == exact_dedup.exact_dedup(empty).count() == 0
