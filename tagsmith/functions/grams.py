"""N-grams of batches of texts as numbers.

A token is a digit: 1 to 3 are the marks, 4 and on the vocabulary's tokens. An n-gram is the number of its digits to the base
of all digits; as no digit is 0, n-grams of different orders are different numbers, and a prefix is a quotient. Each position
of a text has the longest n-gram that counts there, whose prefixes are the shorter ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tagsmith.functions.text import BEGIN, BETWEEN, END, UNKNOWN

MARKS = [UNKNOWN, BEGIN, END]
#: Positions that are looked at at once, and n-grams that a task counts before it passes them on.
WINDOW, PENDING = 1 << 20, 1 << 21
#: -ln(1e-8): what an n-gram that isn't known adds.
UNSEEN = -math.log(1e-8)


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], "i8" if pa.types.is_large_string(texts.type) else "i4")[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    try:
        raw = np.frombuffer(str(data[offsets[0] : offsets[-1]], "utf-8").encode("utf-32-le"), "u4")
    except UnicodeDecodeError:  # as Java reads such bytes
        return points(pa.array([str(data[i:j], "utf-8", "replace") for i, j in zip(offsets, offsets[1:])], pa.string()))
    return raw, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("i8")


def slices(column: pa.Array) -> Iterator[slice]:
    """Rows that have about WINDOW tokens, or a single one that has more."""
    size = (pc.list_value_length if pa.types.is_nested(column.type) else pc.binary_length)(column).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype="i8") // WINDOW)) + 1), len(column)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield slice(int(i), int(j))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    # where a key is another than the one before
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many there are of each."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.diff(np.r_[at, len(keys)])


def total(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys with the sums of their counts; a key comes again if there are more than PENDING."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n > PENDING:
            held = [summed(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0])
            if n > PENDING // 2:
                yield held[0]
                held, n = [], 0
    if held:
        yield summed(*(np.concatenate(x) for x in zip(*held)))


def weighted(values: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct values and the sums of their weights; most texts occur once, and are only sorted."""
    once = weights == 1
    yield counted(values[once])
    if not once.all():
        yield summed(values[~once], weights[~once])


def character_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t and w to token and n."""

    def pairs():
        for batch in batches:
            texts, weights = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(texts):
                raw, size = points(texts[part])
                own = weights[part]
                ends = np.cumsum(size)
                once = np.repeat(own == 1, size)
                n = np.bincount(raw[once])
                yield np.flatnonzero(n), n[n > 0]
                rest = np.flatnonzero(~once)
                for s in range(0, len(rest), WINDOW):
                    at = rest[s : s + WINDOW]
                    yield summed(raw[at].astype("i8"), own[np.searchsorted(ends, at, "right")])

    for keys, n in total(pairs()):
        yield pa.record_batch([pa.array([chr(k) for k in keys], pa.string()), pa.array(n, pa.int64())], ["token", "n"])


class Grams:
    """vocab: the tokens, in the order of their digits. mode: char for texts, token for arrays of tokens."""

    def __init__(self, vocab: list[str], mode: str, low: int, high: int):
        self.vocab, self.mode, self.low, self.high = vocab, mode, low, high
        self.base = len(vocab) + len(MARKS) + 1

    def fits(self) -> bool:
        return self.low >= 1 and self.base**self.high < 1 << 63

    def least(self, order: int) -> int:
        """The smallest number from which on n-grams have that order."""
        return self.base ** (order - 1)

    def _digits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        first = len(MARKS) + 1
        if self.mode == "char":
            if not hasattr(self, "_places"):
                self._places = np.ones(0x110000, "i4")
                self._places[[ord(c) for c in self.vocab]] = np.arange(first, self.base)
            raw, size = points(column)
            return self._places[raw], size
        if not hasattr(self, "_values"):
            self._values = pa.array(self.vocab, pa.string())
        found = pc.index_in(column.flatten().cast(pa.string()), self._values)
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype("i8")
        return pc.fill_null(pc.add(found, first), 1).to_numpy(zero_copy_only=False), size

    def padded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digits of all texts with their marks, and some at the end that don't count; where each text begins and ends."""
        digits, size = self._digits(column)
        pad = self.low - 1
        ends = np.cumsum(size + 2 * pad)
        starts = ends - size - 2 * pad
        out, own = np.full(int(ends[-1]) + self.high, 3, "i4"), np.ones(int(ends[-1]), bool)
        for k in range(pad):
            out[starts + k] = 2
            own[starts + k] = own[ends - 1 - k] = False
        out[: len(own)][own] = digits
        return out, starts, ends

    def _number(self, digits: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        number = digits[at].astype("i8")
        for k in range(1, order):
            number = number * self.base + digits[at + k]
        return number

    def windows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The number of each position, the low tokens at which it begins as a number, and its row."""
        digits, starts, ends = self.padded(column)
        for s in range(0, int(ends[-1]), WINDOW):
            e = min(s + WINDOW, int(ends[-1]))
            number = digits[s:e].astype("i8")
            first = number
            for k in range(1, self.high):
                number = number * self.base + digits[s + k : e + k]
                if k == self.low - 1:
                    first = number
            ok = np.ones(e - s, bool)
            for order in range(self.high):  # what follows an n-gram is a token of the same text: near the end they are shorter
                at = ends - 1 - order
                at = at[(at >= starts) & (at >= s) & (at < e)]
                if order < self.low:
                    ok[at - s] = False
                else:
                    number[at - s] = self._number(digits, at, order)
            r, t = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
            rows = np.repeat(np.arange(r, t), np.minimum(ends[r:t], e) - np.maximum(starts[r:t], s))
            yield number[ok], first[ok], rows[ok]

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts and weights to key and n: of each position its longest n-gram alone."""

        def pairs():
            for batch in batches:
                weights = batch.column(1).to_numpy(zero_copy_only=False)
                for part in slices(batch.column(0)):
                    for number, _, rows in self.windows(batch.column(0)[part]):
                        yield from weighted(number, weights[part][rows])

        for keys, n in total(pairs()):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    def names(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key and n to gram, n and key."""
        tokens = pa.array(["", *MARKS, *self.vocab], pa.string())
        for batch in batches:
            keys, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for order in range(self.low, self.high + 1):
                of = (keys >= self.least(order)) & ((keys < self.least(order + 1)) if order < self.high else True)
                own, parts = keys[of], []
                for k in range(order):
                    parts.append(tokens.take(pa.array(own // self.base ** (order - 1 - k) % self.base)))
                yield pa.record_batch([pc.binary_join_element_wise(*parts, BETWEEN), pa.array(n[of]), pa.array(own)], ["gram", "n", "key"])

    def numbers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """gram and n to key and n; n-grams with other tokens have no key and fall out."""
        digit = {t: i for i, t in enumerate([*MARKS, *self.vocab], 1)}
        # a token is the separator itself, or has none
        token = re.compile(f"({BETWEEN}|[^{BETWEEN}]+)(?:{BETWEEN}|\\Z)")
        for batch in batches:
            keys, n = [], []
            for gram, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = 0
                for t in token.findall(gram):
                    number = number * self.base + digit[t] if number is not None and t in digit else None
                if number is not None:
                    keys.append(number)
                    n.append(k)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def terms(grams: Grams, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order; of each what it and its prefixes add up to, and how many of them add something."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    # a count that isn't positive has no logarithm: it adds nothing and isn't one of the mean's
    size = (n > 0).astype("i1")
    own = np.where(n > 0, 1 / (np.log(np.maximum(n, 1)) + 1), 0.0)
    for k in range(grams.low + 1, grams.high + 1):  # shorter ones are smaller numbers, and done before
        i, j = np.searchsorted(keys, [grams.least(k), grams.least(k + 1)])
        rest, sizes = Terms(grams, keys[:i], own[:i], size[:i]).of(keys[i:j] // grams.base)
        own[i:j] += rest
        size[i:j] += sizes
    return keys, own, size


class Terms:
    """The results of terms(), to look up."""

    def __init__(self, grams: Grams, keys: np.ndarray, sum: np.ndarray, size: np.ndarray):
        self.grams, self.sum, self.size, self._index = grams, sum, size, pd.Index(keys)

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and numbers of terms; an unknown n-gram adds UNSEEN to those of its prefix."""
        sums, sizes = np.zeros(len(number)), np.zeros(len(number), "i1")
        at = self._index.get_indexer(number)
        known = at >= 0
        sums[known], sizes[known] = self.sum[at[known]], self.size[at[known]]
        rest = np.flatnonzero(~known)
        prefix = number[rest]
        while len(rest):
            sums[rest] += UNSEEN
            sizes[rest] += 1
            prefix = prefix // self.grams.base
            longer = prefix >= self.grams.least(self.grams.low)
            rest, prefix = rest[longer], prefix[longer]
            at = self._index.get_indexer(prefix)
            known = at >= 0
            sums[rest[known]] += self.sum[at[known]]
            sizes[rest[known]] += self.size[at[known]]
            rest, prefix = rest[~known], prefix[~known]
        return sums, sizes

    def sums(self, batches: Iterator[pa.RecordBatch], part: int, parts: int) -> Iterator[pa.RecordBatch]:
        """Texts, a, b and w to a, b, w, the sum of what the n-grams add that begin in this part, and their number."""
        for batch in batches:
            column, out, size = batch.column(0), np.zeros(len(batch)), np.zeros(len(batch), "i8")
            for rows in slices(column):
                n = rows.stop - rows.start
                for number, first, row in self.grams.windows(column[rows]):
                    if parts > 1:
                        own = first % parts == part
                        number, row = number[own], row[own]
                    each, sizes = self.of(number)
                    out[rows] += np.bincount(row, each, n)
                    size[rows] += np.bincount(row, sizes, n).astype("i8")
            yield pa.record_batch([batch.column(1), batch.column(2), batch.column(3), pa.array(out), pa.array(size)], ["a", "b", "w", "total", "size"])
