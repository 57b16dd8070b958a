"""TextField: how unlikely a text's n-grams are.

Each text is looked at once however often it occurs: n-grams are counted, and perplexities computed, over distinct texts
with their weights. Where the vocabulary has a place on the driver and n-grams in 63 bits (characters and orders up to five:
6204 of them), both are done on numbers in Arrow batches; else by expressions and joins, with the same results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.functions import grams as numbered
from tagsmith.functions.grams import UNSEEN, Grams, Terms
from tagsmith.functions.text import BEGIN, BETWEEN, END, UNKNOWN, ngrams, tokenized
from tagsmith.operators.base import Generator, GeneratorModel, result, weight_of
from tagsmith.sources.store import TooLarge, bounded, kept

#: A token must occur more often than RARE to be kept.
RARE = 2
#: Tokens up to which the vocabulary is a literal of the plan.
LITERAL = 2000
#: Bytes up to which the table of n-grams is sent to all tasks.
BROADCAST = 128 << 20
#: N-grams that a task looks up at once; of more, each pass over the texts takes a part.
LOOKUP = 3_000_000

# tasks may run where this package isn't
cloudpickle.register_pickle_by_value(numbered)


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches that suit long texts, unless the session has limits of its own."""
    for name, limit in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(limit))


def texts_of(df: DataFrame, field: str, weight: str | None) -> DataFrame:
    """Distinct texts and their weights; a null is the text None."""
    return df.select(F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("None")).alias("t"), weight_of(weight).alias("w")).groupBy("t").agg(F.sum("w").alias("w"))


def vocabulary(texts: DataFrame, mode: str) -> DataFrame:
    if mode == "char":
        _small_batches(texts.sparkSession)
        each = texts.filter("w IS NOT NULL").select("t", "w").mapInArrow(numbered.character_counts, "token string, n long")
    else:
        each = texts.select(F.explode(tokenized(F.col("t"), mode)).alias("token"), F.col("w").alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > RARE).select("token")


def grams_of(vocab: DataFrame, mode: str, low: int, high: int) -> Grams | None:
    """n-grams as numbers, if they can be."""
    try:
        own = Grams(sorted(r.token for r in bounded(vocab)), mode, low, high)
    except TooLarge:
        return None
    return own if own.fits() else None


def mapped(texts: DataFrame, vocab: DataFrame, mode: str) -> DataFrame:
    """a and b (two hashes that stand for the text), w, items: its tokens, those outside of the vocabulary as UNKNOWN."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number, as few bytes of text make many n-grams, and small partitions would be put together
    named = texts.select(*_hashes(F.col("t")), "t", "w").repartition(n, "a", "b")
    try:
        known = sorted(r.token for r in bounded(vocab, LITERAL))
        # isin() with constants is a look-up in a set; array_contains() would go through all of them
        return named.select("a", "b", "w", F.transform(tokenized(F.col("t"), mode), lambda x: F.when(x.isin(known), x).otherwise(UNKNOWN)).alias("items"))
    except TooLarge:
        pass
    each = named.select("a", "b", F.posexplode(tokenized(F.col("t"), mode)).alias("i", "token"))
    each = each.join(vocab.withColumn("in_", F.lit(True)), "token", "left").select("a", "b", "i", F.when(F.col("in_"), F.col("token")).otherwise(UNKNOWN).alias("token"))
    items = each.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("items"))
    return named.drop("t").join(items, ["a", "b"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")


def _looked_at(texts: DataFrame, mode: str, *columns: str) -> DataFrame:
    _small_batches(texts.sparkSession)
    return texts.select(F.col("t") if mode == "char" else tokenized(F.col("t"), mode).alias("t"), *columns)


def ngram_counts(texts: DataFrame, vocab: DataFrame, mode: str, low: int, high: int, base: DataFrame | None = None) -> DataFrame:
    """gram and n, those of base added; key too, where n-grams are numbers."""
    grams = grams_of(vocab, mode, low, high)
    if grams is None:
        table = mapped(texts, vocab, mode).select(F.explode(ngrams(F.col("items"), low, high)).alias("gram"), F.col("w").alias("n"))
        return (table if base is None else table.unionByName(base.select("gram", "n"))).groupBy("gram").agg(F.sum("n").alias("n"))
    longest = _looked_at(texts.filter("w IS NOT NULL"), mode, "w").mapInArrow(grams.counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    prefixes = F.array(*(F.expr(f"key div {grams.base**k}L") for k in range(high - low + 1)))
    table = longest.select(F.explode(F.filter(prefixes, lambda x: x >= grams.least(low))).alias("key"), "n")
    if base is not None:
        table = table.unionByName(base.select("gram", "n").mapInArrow(grams.numbers, "key long, n long"))
    return table.groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(grams.names, "gram string, n long, key long")


def perplexities(texts: DataFrame, vocab: DataFrame, table: DataFrame, mode: str, low: int, high: int) -> DataFrame:
    """a, b, w, perplexity: the mean over a text's n-grams of 1 / (ln(count) + 1), or UNSEEN; null without n-grams."""
    grams = grams_of(vocab, mode, low, high)
    if grams is None:
        return _joined_perplexities(mapped(texts, vocab, mode), table, low, high)
    _small_batches(texts.sparkSession)
    known = table.select("key", "n") if "key" in table.columns else table.select("gram", "n").mapInArrow(grams.numbers, "key long, n long")
    known = known.filter("n IS NOT NULL")
    parts = max(1, math.ceil(known.count() / LOOKUP))
    # an n-gram and its prefixes are in one part
    first = reduce(lambda rest, k: F.when(F.col("key") < grams.least(k + 1), F.expr(f"key div {grams.base ** (k - low)}L")).otherwise(rest), range(high - 1, low - 1, -1), F.expr(f"key div {grams.base ** (high - low)}L"))
    each = _looked_at(texts.select(*_hashes(F.col("t")), "t", "w"), mode, "a", "b", "w")
    sums = [_sums(each, known.filter(first % parts == i) if parts > 1 else known, grams, i, parts) for i in range(parts)]
    own = sums[0] if parts == 1 else reduce(DataFrame.unionByName, sums).groupBy("a", "b").agg(F.first("w").alias("w"), F.sum("total").alias("total"), F.sum("size").alias("size"))
    return own.select("a", "b", "w", F.when(F.col("size") > 0, F.col("total") / F.col("size")).alias("perplexity"))


def _sums(texts: DataFrame, known: DataFrame, grams: Grams, part: int, parts: int) -> DataFrame:
    rows = known.toArrow()
    shared = texts.sparkSession.sparkContext.broadcast(numbered.terms(grams, *(rows[c].to_numpy() for c in ("key", "n"))))
    return texts.mapInArrow(lambda batches: Terms(grams, *shared.value).sums(batches, part, parts), "a long, b long, w long, total double, size long")


def _joined_perplexities(items: DataFrame, table: DataFrame, low: int, high: int) -> DataFrame:
    term = F.when(F.col("n").isNull(), UNSEEN).otherwise(1 / (F.ln("n") + 1))
    table = table.select("gram", "n")
    each = items.select("a", "b", F.explode(ngrams(F.col("items"), low, high)).alias("gram"))
    size = table.agg(F.sum(F.octet_length("gram") + 32)).first()[0] or 0
    if size <= BROADCAST:  # then n-grams are looked up where their text is, and only sums move
        mean = each.join(F.broadcast(table), "gram", "left").groupBy("a", "b").agg(F.avg(term).alias("perplexity"))
    else:
        counted = each.groupBy("a", "b", "gram").agg(F.count(F.lit(1)).alias("k"))
        mean = counted.join(table, "gram", "left").groupBy("a", "b").agg((F.sum(F.col("k") * term) / F.sum("k")).alias("perplexity"))
    return items.select("a", "b", "w").join(mean, ["a", "b"], "left")


class TextField(Generator):
    def __init__(self, field_name: str, lm_mode: str = "char", ngram_range=(3, 5)):
        if lm_mode not in ("char", "token"):
            raise ValueError(f"lm_mode: {lm_mode!r}")
        low, high = (int(x) for x in ngram_range)
        self.params = {"field": field_name, "mode": lm_mode, "low": low, "high": high}

    def fit(self, df: DataFrame, weight: str | None = None, base: GeneratorModel | None = None) -> TextModel:
        p = self.params
        texts = kept(texts_of(df, p["field"], weight), "texts")
        vocab = vocabulary(texts, p["mode"])
        if base is not None:
            vocab = vocab.unionByName(base.tables["vocabulary"]).distinct()
        vocab = kept(vocab, "vocabulary")
        how = p["mode"], p["low"], p["high"]
        table = kept(ngram_counts(texts, vocab, *how, base=None if base is None else base.tables["ngrams"]), "ngrams")
        known = kept(perplexities(texts, vocab, table, *how), "perplexities")
        own = known.filter("perplexity IS NOT NULL")
        mean = own.agg((F.sum(F.col("w") * F.col("perplexity")) / F.sum("w")).alias("mean"))
        square = F.sum(F.col("w") * F.pow(F.col("perplexity") - F.col("mean"), 2))
        spread = own.crossJoin(F.broadcast(mean)).agg(F.first("mean").alias("mean"), F.sqrt(F.try_divide(square, F.sum("w"))).alias("std"))  # one row
        return TextModel(p, {"vocabulary": vocab, "ngrams": table.select("gram", "n"), "spread": kept(spread, "spread"), "known": known.select("a", "b", "perplexity")})


class TextModel(GeneratorModel):
    kind = "TextField"

    def __init__(self, params: dict, tables: dict[str, DataFrame]):
        self.params, self.tables = params, tables
        self.field, self.name = params["field"], params["field"].upper()

    def merge(self, other: TextModel) -> TextModel:
        raise TypeError("a text model continues by fitting on new rows with this one as the base")

    def perplexities(self, df: DataFrame) -> DataFrame:
        """a, b and perplexity of all texts of df, and of those that the model was fitted on, which aren't looked at anew."""
        known = self.tables["known"]
        t = F.coalesce(F.col(f"`{self.field}`").cast("string"), F.lit("None"))
        a, b = _hashes(t)
        # texts move only if there are new ones
        new = kept(df.select(a, b).distinct().join(known, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            return known
        p = self.params
        texts = kept(texts_of(df.select(a, b, t.alias(self.field)).join(new, ["a", "b"], "left_semi"), self.field, None), "texts")
        return known.unionByName(perplexities(texts, self.tables["vocabulary"], self.tables["ngrams"], p["mode"], p["low"], p["high"]).select("a", "b", "perplexity"))

    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        own = self.perplexities(df).select(F.col("a").alias(f"{tag}a"), F.col("b").alias(f"{tag}b"), F.col("perplexity").alias(f"{tag}p"))
        a, b = _hashes(F.coalesce(F.col(f"`{self.field}`").cast("string"), F.lit("None")))
        # hashes as columns, as the text itself needn't move then
        df = df.withColumns({f"{tag}x": a, f"{tag}y": b}).join(own, (F.col(f"{tag}x") == F.col(f"{tag}a")) & (F.col(f"{tag}y") == F.col(f"{tag}b")), "left")
        df = df.crossJoin(F.broadcast(self.tables["spread"].select(F.col("mean").alias(f"{tag}mean"), F.col("std").alias(f"{tag}std"))))  # one row
        return df, self.labelled(F.col(f"{tag}p"), F.col(f"{tag}mean"), F.col(f"{tag}std"))

    def labelled(self, p: Column, mean: Column, std: Column) -> Column:
        far = p - mean
        label = F.when(far < 2 * std, F.lit(None)).when(far < 4 * std, f"{self.name}_HIGH_PERPLEXITY").when(far.isNotNull(), f"{self.name}_EXTREEME_PERPLEXITY")
        return result([label], p * 10)

    def row(self, record: dict) -> tuple[list[str], list[float]]:
        return self.of_text(record.get(self.field))

    def of_text(self, value) -> tuple[list[str], list[float]]:
        import re

        grams = self._local("ngrams", lambda: {r.gram: r.n for r in bounded(self.tables["ngrams"])})
        vocab = self._local("vocabulary", lambda: {r.token: 1 for r in bounded(self.tables["vocabulary"])})
        spread = self._local("spread", lambda: self.tables["spread"].first().asDict())
        text = "None" if value is None else str(value)
        raw = list(text) if self.params["mode"] == "char" else re.findall(r"[^\W_]+|[^ ]", text)
        low = self.params["low"]
        items = [BEGIN] * (low - 1) + [x if x in vocab else UNKNOWN for x in raw] + [END] * (low - 1)
        own = [BETWEEN.join(items[i : i + n]) for n in range(low, self.params["high"] + 1) for i in range(len(items) - n)]
        if not own or spread["mean"] is None:
            return [], []
        p = sum(1 / (math.log(grams[g]) + 1) if g in grams else UNSEEN for g in own) / len(own)
        far = p - spread["mean"]
        labels = [] if far < 2 * spread["std"] else [f"{self.name}_{'HIGH' if far < 4 * spread['std'] else 'EXTREEME'}_PERPLEXITY"]
        return labels, [p * 10]
