"""Operator 8: incremental, reversible line de-duplication on sharded cuckoo filters backed by exact reference counts.

The index has three tables in the shared folder:

    postings  doc_id, h1, h2            each key of each document once
    counts    h1, h2, n_docs, first_doc how many documents refer to a key, and the smallest
    filters   shard, filter             for each shard of keys a cuckoo filter of those with at least two references

Inserting documents adds references; a key that reaches two goes into its shard's filter. Deleting documents takes
references away; a key that falls below two leaves the filter, so its lines come back. A filter that runs full is built
anew from the exact counts. To de-duplicate, lines are probed against the filters, so that the lines of one document
only (nearly all) go no further; the few that pass meet the exact counts, which decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.llm.common import free_name, ship, slices, write_table
from tagsmith.llm.cuckoo import CuckooFilter, Full

#: White space that is stripped from a key; a fixed value.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = str.maketrans(_UPPER, _LOWER)
#: Two independent 64-bit hashes stand for a key: XXH64, with this seed and with the one that follows from hashing SALT.
SEED, SALT = 42, 7
_SEED2 = xxhash.xxh64_intdigest(SALT.to_bytes(4, "little"), SEED)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def hashes(line: str) -> tuple[int, int]:
    """The hashes that the plan gives the key of a line, for rewriting."""
    key = line.strip(BLANKS).translate(_TABLE).encode()
    return xxhash.xxh64_intdigest(key, SEED), xxhash.xxh64_intdigest(key, _SEED2)


def postings_of(docs: DataFrame, min_chars: int, text: str, doc_id: str) -> DataFrame:
    line = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.explode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("line"))
    key = line.filter(F.col("doc_id").isNotNull()).select("doc_id", _key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return key.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SALT), "key").alias("h2")).distinct()


@dataclass(frozen=True)
class LineIndex:
    """min_chars: code points of the shortest key. shard_keys: keys that a filter's shard may have, twice that before the
    number of shards is set anew and all filters are built from the exact counts. small: bytes of all filters up to which every
    task gets them all; beyond, lines go to the shards' tasks."""

    spark: SparkSession
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_chars: int = 10
    shards: int = 0
    shard_keys: int = 250_000
    small: int = 32 << 20

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> LineIndex:
        ship(spark)
        return cls(spark, spark.createDataFrame([], "doc_id long, h1 long, h2 long"), spark.createDataFrame([], "h1 long, h2 long, n_docs long, first_doc long"), spark.createDataFrame([], "shard int, filter binary"), **options)

    def _shard(self) -> Column:
        return F.pmod(F.shiftrightunsigned("h1", 32), F.lit(self.shards)).cast("int")

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineIndex:
        """The index with the references of docs added. Null texts have no keys; rows without a doc_id take no part;
        rows with the same doc_id are one document. References that are there already count once."""
        own = postings_of(docs, self.min_chars, text, doc_id)
        fresh = write_table(own if self.postings.isEmpty() else own.join(self.postings, ["doc_id", "h1", "h2"], "left_anti"), "line-postings")
        gained = fresh.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
        return self._with(self.postings.unionByName(fresh), gained)

    def delete(self, doc_ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """The index without the references of these documents; unknown ids don't matter."""
        gone = doc_ids.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).distinct()
        lost = write_table(self.postings.join(gone, "doc_id", "left_semi"), "line-postings")
        left = write_table(self.postings.join(gone, "doc_id", "left_anti"), "line-postings")
        fewer = lost.groupBy("h1", "h2").agg((-F.count(F.lit(1))).alias("n_docs"), F.lit(None).cast("long").alias("first_doc"))
        first = left.join(lost.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("new_first"))
        return self._with(left, fewer, first)

    def _with(self, postings: DataFrame, change: DataFrame, first: DataFrame | None = None) -> LineIndex:
        was, now = self.counts.select("h1", "h2", "first_doc", F.col("n_docs").alias("before"), F.lit(0).cast("long").alias("change")), change.select("h1", "h2", "first_doc", F.lit(0).cast("long").alias("before"), F.col("n_docs").alias("change"))
        both = was.unionByName(now).groupBy("h1", "h2").agg(F.sum("before").alias("before"), F.sum("change").alias("change"), F.min("first_doc").alias("first_doc"))
        if first is not None:
            both = both.join(first, ["h1", "h2"], "left").withColumn("first_doc", F.when(F.col("change") != 0, F.col("new_first")).otherwise(F.col("first_doc"))).drop("new_first")
        counts = write_table(both.select("h1", "h2", "before", (F.col("before") + F.col("change")).alias("n_docs"), "first_doc"), "line-counts")
        live = counts.filter("n_docs > 0").select("h1", "h2", "n_docs", "first_doc")
        n = live.filter("n_docs >= 2").count()
        grown = replace(self, postings=postings, counts=live)
        if n > 2 * self.shards * self.shard_keys or not self.shards:
            grown = replace(grown, shards=1 << max(0, (n // self.shard_keys).bit_length()), filters=self.filters.limit(0))
            return replace(grown, filters=write_table(grown._changed(grown._keys()), "line-filters"))
        crossed = counts.filter("(before >= 2) != (n_docs >= 2)").select(self._shard().alias("shard"), "h1", "h2", (F.col("n_docs") >= 2).alias("enters"))
        filters = write_table(self._changed(crossed), "line-filters")
        full = [r.shard for r in filters.filter("filter IS NULL").select("shard").collect()]
        if full:  # of these shards, from all their keys
            rebuilt = replace(grown, filters=self.filters.limit(0))._changed(grown._keys().filter(F.col("shard").isin(full)))
            filters = write_table(filters.filter("filter IS NOT NULL").unionByName(rebuilt), "line-filters")
        return replace(grown, filters=filters)

    def _keys(self) -> DataFrame:
        return self.counts.filter("n_docs >= 2").select(self._shard().alias("shard"), "h1", "h2", F.lit(True).alias("enters"))

    def _changed(self, crossed: DataFrame) -> DataFrame:
        """The shards' filters after keys have come and gone; null for an old one that is full. A new one is made larger
        until all keys have a place."""

        def change(key, old, keys):
            h1, h2, enters = (keys.column(c).to_numpy() for c in ("h1", "h2", "enters"))
            came, size, data = (h1[enters].view(np.uint64), h2[enters].view(np.uint64)), 2 * int(enters.sum()), None
            while data is None:
                f = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.for_keys(size)
                try:
                    f.delete(h1[~enters].view(np.uint64), h2[~enters].view(np.uint64))
                    f.insert(*came)
                    data = f.to_bytes()
                except Full:
                    if old.num_rows or size > 1000 * len(h1):
                        break
                    size *= 2
            if data is None and not old.num_rows:
                raise Full(f"shard {key[0].as_py()}: {len(h1)} keys")
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([data], pa.binary())})

        return self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(change, "shard int, filter binary")

    def _passing(self, postings: DataFrame) -> DataFrame:
        """Postings whose key the filters know: all of those with two references or more, and a few others."""
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        shards, schema = self.shards, "doc_id long, h1 long, h2 long"
        if size <= self.small:
            known = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                each = {s: CuckooFilter.from_bytes(b) for s, b in known.value.items()}
                for batch in batches:
                    h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                    shard, hit = (h1 >> np.uint64(32)) % np.uint64(shards), np.zeros(len(h1), bool)
                    for s in np.unique(shard):
                        if int(s) in each:
                            at = np.flatnonzero(shard == s)
                            hit[at] = each[int(s)].contains(h1[at], h2[at])
                    yield batch.filter(pa.array(hit))

            return postings.mapInArrow(probe, schema)

        def probe_shard(key, filters, rows):
            if not filters.num_rows or not rows.num_rows:
                return rows.slice(0, 0).select(["doc_id", "h1", "h2"])
            f = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
            h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            return rows.filter(pa.array(f.contains(h1, h2))).select(["doc_id", "h1", "h2"])

        # a shard with many rows, as that of a very frequent line, is dealt to several tasks with a copy of its filter each
        load = write_table(self.counts.groupBy(self._shard().alias("shard")).agg(F.ceil(F.sum("n_docs") / F.lit(500_000)).cast("int").alias("parts")), "line-loads")
        spread = load.select(F.col("shard").alias("s"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        filters = self.filters.join(spread, F.col("shard") == F.col("s")).select("shard", "part", "filter")
        parts = load.select(F.col("shard").alias("s"), F.col("parts").alias("k"))  # a row for each shard
        dealt = postings.withColumn("shard", self._shard()).join(F.broadcast(parts), F.col("shard") == F.col("s")).select("doc_id", "h1", "h2", "shard", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("part"))
        return filters.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(probe_shard, schema)

    def drops(self) -> DataFrame:
        """doc_id and the keys that it loses: those with two references or more whose first document is another."""
        shared = self.counts.filter("n_docs >= 2").select("h1", "h2", "first_doc")
        lost = self._passing(self.postings).join(shared, ["h1", "h2"]).filter("doc_id != first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))

    def dedup(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """docs, which must be in the index, without the lines that an earlier document has: the text column is replaced,
        n_lines (before dropping) and n_dropped are added, replacing columns of those names. A null text stays null, with
        one line. Rows without a doc_id stay as they are."""
        names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
        mark, own = free_name(docs, "drops"), free_name(docs, "doc")
        drops = self.drops().select(F.col("doc_id").alias(own), F.col("drops").alias(mark))
        rows = docs.select(*(F.col(f"`{c}`") for c in names)).join(drops, F.col(f"`{doc_id}`").cast("long") == F.col(own), "left").drop(own)
        keep = [f for f in docs.schema.fields if f.name in names]
        schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text else f for f in keep), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text, 8 << 20):
                texts, n_lines, n_dropped = batch.column(text).to_pylist(), [], []
                for i, (t, d) in enumerate(zip(texts, batch.column(mark).to_pylist(), strict=True)):
                    total, n = (t or "").count("\n") + 1, 0
                    if d and t is not None:
                        gone = {(x["h1"] % (1 << 64), x["h2"] % (1 << 64)) for x in d}
                        kept = [x for x in t.split("\n") if hashes(x) not in gone]
                        texts[i], n = "\n".join(kept), total - len(kept)
                    n_lines.append(total)
                    n_dropped.append(n)
                new = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*new, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

        return rows.mapInArrow(rewrite, schema)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """A whole table at once: index all documents, then drop. See LineIndex.dedup."""
    return LineIndex.empty(docs.sparkSession, **options).insert(docs, text, doc_id).dedup(docs, text, doc_id)
