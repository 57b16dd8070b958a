"""Operator 4: files of token ids, bit-packed at a fixed width.

A shard file holds the ids of consecutive documents. Ids take the fewest bits that the vocabulary needs, lowest bits
first, in blocks of a fixed number of ids. A multiple of 64 ids fills whole 64-bit words at any width, so a block is
packed and unpacked in 64 vectorised steps. Layout:

    magic | blocks | offsets of blocks | doc ids | whether a doc id is null | first id of each document, and the end
          | footer (8 little-endian 64-bit numbers: version, bits, ids a block, blocks, documents, ids, where the
            offsets begin, 0) | magic
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.bpe import encoder, vocabulary_size
from tagsmith.llm.common import fresh_dir, free_name, ship, slices

MAGIC, VERSION, BLOCK = b"TSIDPAK1", 1, 4096


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Whole groups of 64 ids to 64-bit words; the last group is filled up with 0."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes, words = lanes.reshape(groups, 64), np.zeros((groups, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int) -> np.ndarray:
    words = words.reshape(-1, bits)
    lanes, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, k] = x & mask
    return lanes.reshape(-1)


class ShardWriter:
    """Writes one shard as documents come; holds a block of ids and the documents' ids and offsets."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        if block % 64:
            raise ValueError("a block must hold a multiple of 64 ids")
        self.sink, self.bits, self.block = sink, bits, block
        self.docs, self.nulls, self.starts, self.offsets = [], [], [0], [len(MAGIC)]
        self.left: list[np.ndarray] = []
        self.waiting = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.left.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, 64 * self.block):
            words = pack_bits(ids[i : min(whole, i + 64 * self.block)], self.bits).astype("<u8")
            per = self.block // 64 * self.bits * 8
            for size in (min(per, words.nbytes - k) for k in range(0, words.nbytes, per)):
                self.offsets.append(self.offsets[-1] + size)
            self.sink.write(words.tobytes())
        self.left = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        parts = [np.array(x, kind).tobytes() for x, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8"))]
        footer = [VERSION, self.bits, self.block, len(self.offsets) - 1, len(self.docs), self.starts[-1], self.offsets[-1], 0]
        self.sink.write(b"".join(parts) + np.array(footer, "<u8").tobytes() + MAGIC)


class Shard:
    """Random access to a shard: reads the tables at its end, then only the blocks that are asked for."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = source.read_at(72, end - 72)
        if bytes(tail[64:]) != MAGIC:
            raise ValueError("no id file, or one cut short")
        version, self.bits, self.block, blocks, docs, self.n_ids, at, _ = map(int, np.frombuffer(tail[:64], "<u8"))
        if version != VERSION:
            raise ValueError(f"id file of version {version}")
        table = source.read_at(end - 72 - at, at)
        cut = np.cumsum([0, 8 * (blocks + 1), 8 * docs, docs, 8 * (docs + 1)])
        self.offsets, ids, nulls, self.starts = (np.frombuffer(table[a:b], kind) for a, b, kind in zip(cut, cut[1:], ("<u8", "<i8", "u1", "<u8"), strict=False))
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, nulls, strict=True)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Any range of the shard's ids."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        at, end = int(self.offsets[a]), int(self.offsets[b])
        words = np.frombuffer(self.source.read_at(end - at, at), "<u8")
        return unpack_bits(words, self.bits)[start - a * self.block : stop - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self, budget: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """All documents in turn, some at a time: first, beyond the last, their ids."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + np.uint64(budget), "right")) - 1)
            yield i, j, self.ids(int(self.starts[i]), int(self.starts[j]))
            i = j


def write_ids(df: DataFrame, path: str, where: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 0, shards: int | None = None) -> DataFrame:
    """Encode every text with the tokenizer file, append end_id and write shard files in ascending order of doc_id.

    Null text: as an empty one. Rows with a null doc_id come first; rows of the same doc_id follow the order of their
    text, repeated rows are all kept. Other columns aren't stored. An empty table leaves no shards. Texts are dealt by
    ranges of doc_id once, and encoded where they are written. Each try of a task writes a file of its own; those of the
    tries that Spark took are in the manifest, and the others are deleted. Returns the manifest: shard, path, n_docs, n_ids, start (the ids of
    all shards before it)."""
    spark = df.sparkSession
    ship(spark)
    where = where or fresh_dir(spark, "idfile")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bits = bits_for(vocabulary_size(path))
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], np.uint32)
        fs, base = pafs.FileSystem.from_uri(where)
        fs.create_dir(base, recursive=True)
        name, writer, sink = f"ids-{part:06d}-{uuid.uuid4().hex}.tsid", None, None
        for batch in slices(batches):
            if writer is None:
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(sink, bits)
            for i, x in zip(batch.column("doc_id").to_pylist(), enc.encode_batch(batch.column("text").to_pylist()), strict=True):
                writer.add(i, np.concatenate([x, end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [f"{where}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]]}, schema=_MANIFEST)

    made = sorted(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").collect(), key=lambda r: r.shard)
    _delete_others(where, {r.path.rpartition("/")[2] for r in made})
    starts = np.cumsum([0, *(r.n_ids for r in made)])
    return spark.createDataFrame([(*r, int(s)) for r, s in zip(made, starts[:-1], strict=True)], "shard long, path string, n_docs long, n_ids long, start long")


def _delete_others(where: str, names: set[str]) -> None:
    """Files of tries that failed or came second."""
    fs, base = pafs.FileSystem.from_uri(where)
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if f.base_name.endswith(".tsid") and f.base_name not in names:
            with contextlib.suppress(OSError):
                fs.delete_file(f.path)


_MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_ids(manifest: DataFrame) -> DataFrame:
    """The documents of all shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32-bit), ids_crc32."""
    ship(manifest.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    shard = Shard(f)
                    for i, j, ids in shard.runs():
                        own = shard.starts[i : j + 1].astype(np.int64)
                        each = [ids[a:b].astype("<u4").tobytes() for a, b in zip(own[:-1] - own[0], own[1:] - own[0], strict=True)]
                        columns = (shard.doc_ids[i:j], own[:-1] + base, np.diff(own), each, [zlib.crc32(x) for x in each])
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    key = free_name(manifest, "k")
    spread = manifest.withColumn(key, F.col("shard")).repartition(max(1, min(1 << 16, manifest.count())), key).drop(key)
    return spread.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def dataset(spark: SparkSession, manifest: DataFrame, start: int, stop: int) -> np.ndarray:
    """A range of the whole corpus' ids, from the shards that hold it, on the driver: for training loops and spot checks."""
    rows = manifest.filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).orderBy("start").collect()
    parts = []
    for r in rows:
        fs, at = pafs.FileSystem.from_uri(r.path)
        with fs.open_input_file(at) as f:
            parts.append(Shard(f).ids(max(0, start - r.start), min(r.n_ids, stop - r.start)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
