"""Operator 5: bounded-space online packing of documents into training sequences.

Each partition packs its documents as they come, with a fixed number of open windows. A document longer than a window
fills whole windows; what is left of it goes to the open window that it fits best. If it fits none while all windows
are open, the fullest is topped up with the head of the piece and emitted, and the rest goes on. What stands open at
the end of a partition is merged, fullest first, into full windows and one rest. The rests of many partitions are merged
in rounds, many to one at a time, until one is left. Only rests move between tasks: less than a window for each
partition, with its ids; texts don't.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.llm.bpe import encoder
from tagsmith.llm.common import durable, ship, slices, write_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in PIECES.split(", "))])
#: Bits of a sequence id below the packer's number (32 bits, as Spark's are), and below the round's.
_LOCAL, _ROUND = 25, 57


class Packer:
    """A piece is (doc_id, start, ids, doc_tokens). Emits windows as lists of pieces."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.most = window, open_windows
        self.open: list[tuple[int, list]] = []  # free places, pieces

    def add(self, doc_id, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> Iterator[list]:
        total, at, end = len(ids) if doc_tokens is None else doc_tokens, 0, len(ids)
        while end - at >= self.window:
            yield [(doc_id, start + at, ids[at : at + self.window], total)]
            at += self.window
        while at < end:
            left = end - at
            fits = [(free, k) for k, (free, _) in enumerate(self.open) if free >= left]
            if fits:
                free, k = min(fits)
                self.open[k][1].append((doc_id, start + at, ids[at:end], total))
                self.open[k] = (free - left, self.open[k][1])
                if free == left:
                    yield self.open.pop(k)[1]
                return
            if len(self.open) < self.most:
                self.open.append((self.window - left, [(doc_id, start + at, ids[at:end], total)]))
                return
            free, k = min((free, k) for k, (free, _) in enumerate(self.open))
            pieces = self.open.pop(k)[1]
            pieces.append((doc_id, start + at, ids[at : at + free], total))
            at += free
            yield pieces

    def merge(self) -> Iterator[list]:
        """Empty the open windows into full ones and one rest, which comes last. The fullest stay whole as far as they
        can: the emptiest are cut to fill them."""
        left = sorted(self.open, key=lambda x: x[0])
        self.open, donors = [], []
        while left:
            free, pieces = left.pop(0)
            while free and (donors or left):
                if not donors:
                    donors = left.pop()[1]
                doc_id, start, ids, total = donors.pop()
                take = min(free, len(ids))
                pieces.append((doc_id, start + len(ids) - take, ids[len(ids) - take :], total))
                if take < len(ids):
                    donors.append((doc_id, start, ids[: len(ids) - take], total))
                free -= take
            yield pieces
        if donors:
            yield donors


def _rows(windows: list[tuple[int, list]], with_ids: bool) -> pa.RecordBatch:
    out: list[list] = [[] for _ in _SCHEMA]
    for seq, pieces in windows:
        at = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            for column, x in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), total, seq, at, raw if with_ids else None), strict=True):
                column.append(x)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)


def _next(seq: int) -> int:
    if (seq + 1) >> _LOCAL != seq >> _LOCAL:
        raise OverflowError(f"a partition has more than {1 << _LOCAL} sequences: use more partitions")
    return seq + 1


def _full(pieces: list, window: int) -> bool:
    return sum(len(p[2]) for p in pieces) == window


def pack(df: DataFrame, path: str, window: int = 1024, open_windows: int = 64, fan_in: int = 64, end_id: int | None = 0, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents, each id in exactly one: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (binary, only if keep_ids). All sequences but the last are full.

    Null text: as an empty one, so just end_id; with no end_id such a document has no piece. Null doc_ids and repeated
    rows are packed as documents of their own. Other columns are left out. An empty table gives no pieces. The windows
    that a partition has open are bounded by open_windows, whatever it holds."""
    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer, seq = encoder(path), Packer(window, open_windows), TaskContext.get().partitionId() << _LOCAL
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in slices(batches):
            out = []
            for i, x in zip(batch.column("doc_id").to_pylist(), enc.encode_batch(batch.column("text").to_pylist()), strict=True):
                for pieces in packer.add(i, np.concatenate([x, end])):
                    out.append((seq, pieces))
                    seq = _next(seq)
            yield _rows(out, keep_ids)
        for pieces in packer.merge():
            yield _rows([(seq, pieces)], keep_ids or not _full(pieces, window))
            seq = _next(seq)

    made = write_table(source.mapInArrow(run, PIECES), "packed")
    size = F.sum("length").over(Window.partitionBy("sequence_id"))
    partial = made.filter(F.col("ids").isNotNull()).withColumn("size", size).filter(F.col("size") < window).drop("size")
    done = made.filter(F.col("ids").isNull()) if not keep_ids else made.withColumn("size", size).filter(F.col("size") == window).drop("size")
    last = made.filter(F.col("ids").isNotNull()).agg(F.max(F.shiftright("sequence_id", _LOCAL))).first()[0] or 0
    rounds = max(1, math.ceil(math.log(last + 1, fan_in) - 1e-9))
    for k in range(1, rounds + 1):
        merged = durable(_merge_round(partial, fan_in**k, k, window))
        if k == rounds:
            done = done.unionByName(merged)
        else:
            full = merged.withColumn("size", size)
            done = done.unionByName(full.filter(F.col("size") == window).drop("size"))
            partial = full.filter(F.col("size") < window).drop("size")
    return done if keep_ids else done.drop("ids")


def _merge_round(partial: DataFrame, span: int, k: int, window: int) -> DataFrame:
    """Merge the rests of the packers of each span of numbers; ids of new sequences say the round, so none is used twice."""

    def merge(key, table):
        packer, seq = Packer(window, 1 << 30), (k << _ROUND) | (key[0].as_py() * span << _LOCAL)
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        for _, own in groupby(rows, key=lambda r: r["sequence_id"]):
            pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in own]
            packer.open.append((window - sum(len(p[2]) for p in pieces), pieces))
        return pa.Table.from_batches([_rows([(seq + i, p) for i, p in enumerate(packer.merge())], True)], _SCHEMA)

    group = F.floor(F.shiftright(F.col("sequence_id").bitwiseAND((1 << _ROUND) - 1), _LOCAL) / span).cast("long")
    return partial.groupBy(group.alias("group")).applyInArrow(merge, PIECES)
