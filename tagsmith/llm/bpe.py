"""Operator 1: byte-pair encoding and decoding, long unsplit text by tree concatenation.

A text longer than a leaf is halved, wherever its middle is, until all parts are leaves. The leaves of all texts of a batch
are encoded in one go, in parallel, and neighbours are joined level by level. A join re-encodes a window of tokens
around the seam and doubles it until both sides agree exactly: on each side, the window's ids and those that the half had
there run alike up to a place where no pre-token can reach across (after a letter, digit or sign, before white space or
another of these), or the window lies within one pre-token and they agree at its ends. In the first case both sides of the place are encoded for
themselves; in the second, as a byte-pair encoding is determined by its adjacent token pairs, every pair of the joined
sequence is as in a whole encoding. So the result is exact; a text without any such place is in the end one window.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.llm.common import ship, slices

#: The pre-tokenizer's pattern; a fixed value of the byte-level format.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside of blocks whose classes have long been the same in all versions of Unicode: libraries may differ.
_UNSURE = re.compile("[^\x00-\x1b\x20-\u036f\u0386-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20b9\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f320]")
#: Letters, digits, signs and white space of ASCII: a run of one of these kinds is within one pre-token.
_BLANK = " \t\n\x0b\x0c\r"
_RUNS = tuple(re.compile(x) for x in (rb"[A-Za-z]+", rb"[0-9]+", rb"[!-&(-/:-@\[-`{-~]+", rb"[ \t\n\x0b\x0c\r]+"))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """The bytes of each token of a vocabulary, flat, for vectorised decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        words = {i: w for w, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        each = [b""] * (max(words) + 1)
        for i, w in words.items():
            each[i] = bytes(alphabet[c] for c in w) if all(c in alphabet for c in w) else w.encode()
        self.size = len(each)
        self.each = each
        self.lengths = np.array([len(b) for b in each], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return _gather(self.flat, self.starts[ids], self.lengths[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.join(ids).decode("utf-8", "replace")


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s:s+n] for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def places_of(text: str) -> set[int]:
    """Offsets in bytes that no pre-token reaches across, whatever stands around the text: after a letter, digit or sign
    and before white space or another of these kinds. An apostrophe may go with what follows."""

    def kind(c: str) -> int:
        if c in _BLANK:
            return 0
        return 4 if c == "'" else 5 if _UNSURE.match(c) or c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3

    out, at, was = set(), 0, 5
    for c in text:
        now = kind(c)
        if (now == 0 and 1 <= was <= 4) or (1 <= was <= 3 and 1 <= now <= 3 and was != now):
            out.add(at)
        at, was = at + len(c.encode()), now
    return out


class TreeEncoder:
    """leaf: characters of the longest part that is encoded whole. joins: how many seams there were."""

    def __init__(self, path: str, leaf: int = 2048):
        from tokenizers import Tokenizer, pre_tokenizers

        self.leaf, self.joins = leaf, 0
        self.tok, self.raw = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tok, self.raw):
            t.no_truncation()
            t.no_padding()
        self.raw.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = TokenBytes(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.cuts = (
            (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), spec["normalizer"], spec["model"].get("dropout"), spec["model"].get("ignore_merges", False)) == ("ByteLevel", False, True, None, None, False)
            and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        )
        self.special = {x["content"]: x["id"] for x in added}
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.ranked = self._by_rank(spec) if self.cuts else None

    def _by_rank(self, spec: dict):
        """A faster encoder of the same vocabulary, if ids follow the order of the merges: then a token's id is its rank."""
        try:
            import tiktoken
        except ImportError:
            return None
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)) or {*merged} & {vocab[c] for c in byte_alphabet()} or len(merged) + 256 + len(set(self.special.values()) & set(vocab.values())) != len(vocab):
            return None
        ranks = {self.bytes.each[i]: i for i in (*merged, *(vocab[c] for c in byte_alphabet()))}
        return tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as whole encoding gives them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        parts, owners = [], []
        for k, t in enumerate(texts):
            if self.any_special is not None and self.any_special.search(t):
                out[k] = self._with_special(t)
            else:
                own = self.leaves(t)
                parts += own
                owners += [k] * len(own)
        done = self._whole(parts)
        for k, own in groupby(zip(owners, done, strict=True), key=lambda x: x[0]):
            out[k] = self._joined([ids for _, ids in own])
        return out

    def leaves(self, text: str) -> list[str]:
        """Halves of halves, down to the leaf's size; a text is one leaf if the vocabulary's format isn't the known one."""
        parts = [text]
        while self.cuts and max(map(len, parts)) > self.leaf:
            parts = [h for s in parts for h in ((s[: len(s) // 2], s[len(s) // 2 :]) if len(s) > self.leaf else (s,))]
        return parts

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that aren't cut, in one batch."""
        out: list[np.ndarray | None] = [self.ranked.encode_to_numpy(t, disallowed_special=()) if self.ranked is not None and (t.isascii() or not _UNSURE.search(t)) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = np.array(x.ids, np.uint32)
        return out

    def _with_special(self, text: str) -> np.ndarray:
        parts = [x for x in self.any_special.split(text) if x]
        plain = iter(self.encode_batch([x for x in parts if x not in self.special]))
        return np.concatenate([np.array([self.special[x]], np.uint32) if x in self.special else next(plain) for x in parts])

    def _joined(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two encoded neighbours' text, from a window that grows until both of its sides agree."""
        if not len(left) or not len(right):
            return left if len(left) else right
        self.joins += 1
        tokens, size = self.bytes.each, 8
        inner = lambda i: 0x80 <= tokens[i][0] < 0xC0  # noqa: E731  the token starts within a character
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            while a > 0 and inner(left[a]):
                a -= 1
            while b < len(right) and inner(right[b]):
                b += 1
            window = b"".join(tokens[i] for i in (*left[a:], *right[:b]))
            before, after = left[a:], right[:b]
            if any(run.fullmatch(window) for run in _RUNS):
                ids = np.array(self.raw.encode(window.decode(), add_special_tokens=False).ids, np.uint32)
                i = 0 if a == 0 or np.array_equal(ids[:2], before[:2]) else None
                j = 0 if b == len(right) or np.array_equal(ids[-2:], after[-2:]) else None
            else:
                [ids], places = self._whole([window.decode()]), places_of(window.decode())
                i = 0 if a == 0 else self._agreed(ids, before, places, 0, 1)
                j = 0 if b == len(right) else self._agreed(ids[::-1], after[::-1], places, len(window), -1)
            if i is not None and j is not None:
                return np.concatenate([left[: a + i], ids[i : len(ids) - j], right[b - j :]])
            size *= 2

    def _agreed(self, ids: np.ndarray, own: np.ndarray, places: set[int], at: int, step: int) -> int | None:
        """How many tokens from an end of the window run alike, up to the first place."""
        for k, (x, y) in enumerate(zip(ids.tolist(), own.tolist(), strict=False)):
            if at in places:
                return k
            if x != y:
                return None
            at += step * len(self.bytes.each[x])
        return None


@lru_cache(maxsize=2)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """df and two columns: ids (binary, little-endian unsigned 32-bit) and their number. Null text: as an empty one, no
    ids. Any other column passes through; columns of df by the names of the new ones are replaced."""
    ship(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name.lower() not in (ids.lower(), n_tokens.lower())]
    schema = T.StructType([*keep, T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, text):
            each = enc.encode_batch([x or "" for x in batch.column(text).to_pylist()])
            columns = [*(batch.column(n) for n in names), pa.array([len(x) for x in each], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, n_tokens, ids])

    source = df if text in names else df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`"))
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df and the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids: null."""
    ship(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name.lower() != decoded.lower()]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in slices(batches, ids):
            texts = [None if x is None else table.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, decoded])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(decoded, T.StringType())]))
