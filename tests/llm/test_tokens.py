"""Encoding, id files and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tagsmith.llm import bpe, idfile, packing
from tagsmith.llm.queries import vocabulary

ALPHABET = ["a", "b", "é", "漢字", " ", "  ", "\n", "\t", "'s", "'", "1", "2", "!!", "…", "🙂", "\x1c", "͸", "<|endoftext|>", "the", "ing", "ß", " ", "　"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(vocabulary())


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    runs = [lambda: rng.choices(ALPHABET, k=rng.randint(0, 60)), lambda: [rng.choice("abcdeéß漢") for _ in range(rng.randint(0, 300))], lambda: [rng.choice(" \n\t") for _ in range(rng.randint(0, 100))], lambda: ["ab"] * rng.randint(0, 200)]
    return ["".join(runs[i % 4]()) for i in range(n)]


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_tree_equals_whole_encoding(reference, leaf):
    enc = bpe.TreeEncoder(vocabulary(), leaf=leaf)
    own = texts(400, leaf)
    for t, ids in zip(own, enc.encode_batch(own), strict=True):
        assert ids.tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_tree_of_a_very_long_run(reference):
    enc, rng = bpe.TreeEncoder(vocabulary()), random.Random(2)
    for alphabet in ("abcdefg", "é漢字🙂", "=", " "):
        t = "".join(rng.choice(alphabet) for _ in range(60_000))
        assert enc.encode_batch([t])[0].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_long_documents_go_through_the_tree(reference):
    """All texts of the table, at the operator's own leaf: joins take place, and all ids are the library's."""
    own = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL AND length(text) > 2048").fetchall()]
    enc = bpe.TreeEncoder(vocabulary())
    got = [x for k in range(0, len(own), 64) for x in enc.encode_batch(own[k : k + 64])]
    assert enc.joins >= len(own) > 1000
    for t, ids, want in zip(own, got, reference.encode_batch_fast(own, add_special_tokens=False), strict=True):
        assert np.array_equal(ids, want.ids), t[:80]


def test_short_documents_are_the_librarys_too(reference):
    own = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE length(text) <= 2048").fetchall()]
    enc = bpe.TreeEncoder(vocabulary())
    for t, ids, want in zip(own, enc.encode_batch(own), reference.encode_batch_fast(own, add_special_tokens=False), strict=True):
        assert np.array_equal(ids, want.ids), t[:80]


def test_decoding_also_of_broken_sequences(reference):
    table, rng = bpe.TokenBytes(vocabulary()), random.Random(4)
    for t in texts(300, 9):
        ids = [i for i in reference.encode(t, add_special_tokens=False).ids if rng.random() < 0.9]
        assert table.decode(np.array(ids, np.uint32)) == reference.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(texts(60, 5))] + [(100, None), (101, ""), (102, "word " * 9000), (103, "x" * 5000), (104, "same"), (105, "same"), (105, "same"), (-7, "negative"), (None, "no id")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, ids string, part int").repartition(5)


def test_round_trip(docs, reference):
    rows, df = docs
    out = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "part", "n_tokens", "ids", "decoded"}
    for r in out:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "") and r.part == 1
        assert hashlib.sha256(np.array(ids, "<u4").tobytes()).digest() == hashlib.sha256(r.ids).digest()


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31, 32])
def test_bits(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint64)
        words = idfile.pack_bits(ids, bits)
        assert len(words) == -(-n // 64) * bits
        assert (idfile.unpack_bits(words, bits)[:n] == ids).all()
    assert [idfile.bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_id_files(spark, docs, reference):
    rows, df = docs
    manifest = idfile.write_ids(df, vocabulary(), shards=3)
    out = idfile.read_ids(manifest).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t) in zip(out, ordered, strict=True):
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in out])
    rng = random.Random(1)
    for _ in range(20):  # random access, across blocks and shards
        a, b = sorted(rng.randint(0, at) for _ in range(2))
        assert (idfile.dataset(spark, manifest, a, b) == every[a:b]).all()


def test_files_cut_short_are_refused(tmp_path):
    from pyarrow import fs

    (tmp_path / "x").write_bytes(b"0" * 100)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f, pytest.raises(ValueError, match="no id file"):
        idfile.Shard(f)


def check_packing(out, rows, reference, window, keep=True):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i in {i for i, _ in rows}:
        want = sorted([*reference.encode(t or "", add_special_tokens=False).ids, 0] for j, t in rows if j == i)
        if len(want) > 1:  # documents of one doc_id are packed each by itself
            assert sum(r.length for r in by_doc[i]) == sum(map(len, want))
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = np.array(want[0][r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(own), len(want[0]))
            assert not keep or bytes(r.ids) == own
            at += r.length
        assert at == len(want[0])
    sizes = []
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(z <= window for z in sizes) and sum(z < window for z in sizes) <= 1


@pytest.mark.parametrize(("window", "open_windows", "fan_in"), [(1024, 64, 64), (16, 2, 2), (7, 1, 3)])
def test_packing(docs, reference, window, open_windows, fan_in):
    rows, df = docs
    out = packing.pack(df, vocabulary(), window, open_windows, fan_in, keep_ids=True).collect()
    check_packing(out, rows, reference, window)
    plain = packing.pack(df, vocabulary(), window, open_windows, fan_in)
    assert "ids" not in plain.columns
    check_packing(plain.collect(), rows, reference, window, keep=False)


def test_packer_prefers_the_best_fit():
    p = packing.Packer(10, 3)
    for i, n in enumerate((7, 5, 8)):
        assert list(p.add(i, np.zeros(n, np.uint32))) == []
    assert list(p.add(3, np.zeros(3, np.uint32)))[0][0][0] == 0  # fills the window of the first exactly
    [full] = p.add(4, np.zeros(10, np.uint32))
    assert [x[0] for x in full] == [4]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, vocabulary()), vocabulary()).count() == 0
    assert idfile.read_ids(idfile.write_ids(empty, vocabulary())).count() == 0
    assert packing.pack(empty, vocabulary()).count() == 0
