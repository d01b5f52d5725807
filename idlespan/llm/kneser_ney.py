"""Quality by the perplexity of an interpolated modified Kneser-Ney model over characters.

Documents are dealt into chunks of bounded size.  A chunk sends every different trigram of its texts once, with how often trusted
texts have it; those rows, sharded by (language, trigram), are both the model's counts and the questions asked of it.  Lower orders
are continuation counts of the order above (how many different characters stand before), each order has its three discounts per
language from its counts of counts (Chen and Goodman, 1999), and probabilities are joined from characters up to trigrams.  The answers
go back to the chunk, which adds them up per document.  So what is shuffled is one copy of the texts and, per chunk, its different
trigrams; no table is broadcast and none is held whole in a task.

A character is its code point, all beyond the first 65535 and NUL being one symbol; 0 stands before the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import parts_for, saved, whole_text, without_ids

CHUNK_BYTES = 16 << 20
OTHER = 65535
DENSE = 1 << 25
SLICE = 1 << 20
QUANTILE, SHORT = 0.995, 4.0


@dataclass
class Coded:
    """Trigrams of some texts: ``gram`` numbers into ``keys``-like cubes of ``symbols``; ``start`` is where each text begins."""
    gram: np.ndarray
    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def key(self, gram: np.ndarray) -> np.ndarray:
        """Three 16-bit characters in one integer, the last in the low bits."""
        s = len(self.symbols)
        gram = gram.astype(np.int64)
        a, b, c = (self.symbols[x] for x in (gram // (s * s), gram // s % s, gram % s))
        return a << 32 | b << 16 | c

    def different(self) -> np.ndarray:
        cube = len(self.symbols) ** 3
        if cube > DENSE:
            return np.unique(self.gram)
        there = np.zeros(cube, bool)
        for i in range(0, len(self.gram), SLICE):
            there[self.gram[i:i + SLICE]] = True
        return np.flatnonzero(there).astype(self.gram.dtype)

    def runs(self) -> Iterator[tuple[int, int]]:
        """Texts from one to another, with some ``SLICE`` trigrams together."""
        ends, at = self.start + self.length, 0
        while at < len(ends):
            to = min(int(np.searchsorted(ends, self.start[at] + SLICE)) + 1, len(ends))
            yield at, to
            at = to


def coded(texts: list[str]) -> Coded:
    """Codes are held as 16-bit integers and trigrams as 32-bit ones, if these are enough; what is wider lives for one run of texts."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64)
    c = Coded(np.zeros(0, np.int64), np.zeros(0, np.int64), start, length)
    codes, seen = [], np.zeros(OTHER + 1, bool)
    for at, to in c.runs():
        joined = "".join("\0\0" + t.replace("\0", chr(OTHER)) for t in texts[at:to])
        codes.append(np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), OTHER).astype(np.uint16))
        seen[codes[-1]] = True
    c.symbols = np.flatnonzero(seen)
    n = len(c.symbols)
    place = np.zeros(OTHER + 1, np.int64)
    place[c.symbols] = np.arange(n)
    c.gram = np.empty(int(length.sum()), np.int32 if n ** 3 < 1 << 31 else np.int64)
    for i, (at, to) in enumerate(c.runs()):
        code, codes[i] = place[codes[i]], None
        gram = (code[:-2] * n + code[1:-1]) * n + code[2:]
        head = (np.cumsum(length[at:to] + 2) - 2 - length[at:to])[1:]   # where the two symbols before each further text stand
        real = np.ones(len(gram), bool)
        real[head - 2] = real[head - 1] = False                         # windows that reach into the next text
        c.gram[start[at]:start[to - 1] + length[to - 1]] = gram[real]
    return c


def _languages(table: pa.Table) -> Iterator[tuple[str, list[int | None], list[str]]]:
    by: dict[str, tuple[list, list]] = {}
    for i, text, lang in zip(*(table.column(c).to_pylist() for c in ("id", "text", "lang"))):
        ids, texts = by.setdefault(lang, ([], []))
        ids.append(i)
        texts.append(text)
    for lang, (ids, texts) in by.items():
        yield lang, ids, texts


GRAMS = pa.schema([("chunk", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("seen", pa.int64())])
SCORES = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("bits", pa.float64())])


def _ask(key: tuple, docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Every different trigram of a chunk's texts, with its count in trusted ones."""
    good, out = set(trusted.column("id").to_pylist()), []
    chunk = key[0].as_py()
    for lang, ids, texts in _languages(docs):
        c = coded(texts)
        if not len(c.gram):
            continue
        grams = c.different()
        train, seen = np.array([i in good for i in ids]), np.zeros(len(grams), np.int64)
        for at, to in c.runs():
            own = c.gram[c.start[at]:c.start[to - 1] + c.length[to - 1]][np.repeat(train[at:to], c.length[at:to])]
            if len(own):
                found, times = np.unique(own, return_counts=True)
                seen[np.searchsorted(grams, found)] += times
        out.append(pa.table([pa.array([chunk] * len(grams), pa.int32()), pa.array([lang] * len(grams)),
                             pa.array(c.key(grams)), pa.array(seen)], schema=GRAMS))
    return pa.concat_tables(out) if out else GRAMS.empty_table()


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as they are.  No filter or projection is pushed through, so every use below reads one and the same exchange."""
    yield from batches


def _score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Bits of every document of a chunk."""
    told: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    langs = answers.column("lang").to_numpy(zero_copy_only=False)
    keys, bits = answers.column("key").to_numpy(), answers.column("bits").to_numpy()
    out = []
    for lang, ids, texts in _languages(docs):
        c = coded(texts)
        total = np.zeros(len(ids))
        if len(c.gram):
            own = langs == lang
            order = np.argsort(keys[own])
            told = (keys[own][order], bits[own][order])
            grams = c.different()
            each = told[1][np.searchsorted(told[0], c.key(grams))]
            for at, to in c.runs():
                some, first = c.length[at:to] > 0, c.start[at]
                if some.any():
                    bits_of_all = each[np.searchsorted(grams, c.gram[first:c.start[to - 1] + c.length[to - 1]])]
                    total[at:to][some] = np.add.reduceat(bits_of_all, c.start[at:to][some] - first)
        out.append(pa.table([pa.array(ids, pa.int64()), pa.array([lang] * len(ids)), pa.array(c.length), pa.array(total)], schema=SCORES))
    return pa.concat_tables(out) if out else SCORES.empty_table()


def _discounts(grams: DataFrame) -> DataFrame:
    """Per language the discounts of grams counted once, twice, and more often; k / 2 where the counts give none in (0, k]."""
    n = {k: F.sum((F.col("a") == k).cast("long")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)}
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def d(k: int) -> Column:
        exact = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        return F.when((exact > 0) & (exact <= k), exact).otherwise(F.lit(k / 2)).alias(f"d{k}")
    return grams.groupBy("lang").agg(*n.values()).select("lang", *[d(k) for k in (1, 2, 3)])


def _probability(grams: DataFrame, lower: DataFrame | None) -> DataFrame:
    """``p`` of every row (lang, key, a: its count in this order, 0 for asked only) from the order below."""
    counted = grams.filter("a > 0")
    context = F.shiftrightunsigned("key", 16)
    a = F.col("a")
    stats = (counted.groupBy("lang", context.alias("context"))
             .agg(F.sum("a").alias("all"), *[F.sum((a == k if k < 3 else a >= 3).cast("long")).alias(f"c{k}") for k in (1, 2, 3)])
             .join(_discounts(counted), "lang"))
    rows = grams.withColumn("context", context).join(stats, ["lang", "context"], "left")
    if lower is None:
        rows = rows.withColumn("below", F.lit(1.0 / (OTHER + 1)))
    else:
        mask = (1 << 32) - 1 if lower.columns[1] == "key2" else OTHER
        rows = rows.withColumn(lower.columns[1], F.col("key").bitwiseAND(F.lit(mask).cast("long"))).join(
            lower.withColumnRenamed("p", "below"), ["lang", lower.columns[1]])
    off = F.when(a == 0, 0.0).when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
    spread = F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")
    mixed = (F.greatest(a - off, F.lit(0.0)) + spread * F.col("below")) / F.col("all")
    return rows.select("lang", "key", F.coalesce(mixed, F.col("below")).alias("p"))


def _lower(grams: DataFrame, bits: int) -> DataFrame:
    """The grams without their first character: how many different ones stand before it in trusted text."""
    return grams.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("key")).agg(
        F.sum((F.col("a") > 0).cast("long")).alias("a"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``id``, ``lang``, ``n_chars`` and ``bits`` (minus log2 of the probability of the whole text) of every row of ``docs``.

    The model is trained on all texts of ``docs`` whose id is in ``trusted`` (one column, ``id``).
    """
    text = whole_text(text_col)
    chunks = parts_for(docs.agg(F.sum(F.octet_length(text))).first()[0], chunk_bytes, 12)

    def chunk(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(chunks)).cast("int").alias("chunk")
    ident = F.col(id_col).cast("long")
    rows = docs.select(chunk(ident), ident.alias("id"), text.alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")).repartition(chunks, "chunk")
    good = trusted.select(chunk(F.col("id").cast("long")), F.col("id").cast("long").alias("id")).repartition(chunks, "chunk")
    asked = (rows.groupBy("chunk").cogroup(good.groupBy("chunk"))
             .applyInArrow(_ask, "chunk int, lang string, key long, seen long").repartition("lang", "key")
             .mapInArrow(_same, "chunk int, lang string, key long, seen long"))
    three = asked.groupBy("lang", "key").agg(F.sum("seen").alias("a"))
    two = _lower(three, 32)
    one = _lower(two, 16)
    p1 = _probability(one, None).withColumnRenamed("key", "key1")
    p2 = _probability(two, p1).withColumnRenamed("key", "key2")
    p3 = _probability(three, p2)
    answers = asked.select("chunk", "lang", "key").join(p3, ["lang", "key"]).select(
        "chunk", "lang", "key", (-F.log2("p")).alias("bits")).repartition(chunks, "chunk")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score, "id long, lang string, n_chars long, bits double")


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """``lang``, ``threshold``: the nearest-rank quantile of ``adjusted``, from a histogram of thousandths of a bit."""
    bins = scores.groupBy("lang", F.round("adjusted", 3).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    ranked = bins.select("lang", "value", F.sum("n").over(by.orderBy("value")).alias("upto"), F.sum("n").over(by).alias("all"))
    return ranked.filter(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("lang").agg(F.min("value").alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quantile: float = QUANTILE, margin: float = 0.0, short: float = SHORT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: id, ``lang``, ``n_chars``, ``bits_per_char``, ``perplexity`` (per character), ``threshold``, ``accepted``.

    ``labels`` (``doc_id``, ``quality``, ``toxic``) names the trusted texts: quality 1, not toxic, in all its rows.  A document goes if its
    bits per character, less ``short`` / sqrt(characters) for the noise of short texts, exceed by more than ``margin`` the ``quantile``
    of the trusted documents of its language.  A language without trusted text has no threshold, and its documents stay.  A null language is
    a language of its own (empty string).  Null and empty texts have 0 bits per character and stay.  Null ids are never trusted; rows
    that repeat an id are scored one by one; other columns are ignored; empty tables give no rows.
    """
    trusted = (labels.groupBy(F.col("doc_id").cast("long").alias("id"))
               .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
               .filter("quality = 1 and toxic = 0 and id is not null").select("id"))
    scores = saved(perplexities(docs, trusted, id_col, text_col, lang_col, chunk_bytes), "perplexities")
    n = F.greatest("n_chars", F.lit(1))
    scores = scores.withColumn("per_char", F.col("bits") / n).withColumn("adjusted", F.col("per_char") - short / F.sqrt(n))
    limits = thresholds(scores.filter("n_chars > 0").join(trusted, "id", "left_semi"), quantile)
    scored = scores.join(limits, "lang", "left")
    over = (F.col("n_chars") > 0) & (F.col("adjusted") > F.col("threshold") + margin)
    return scored.select(F.col("id").alias(id_col), "lang", "n_chars", F.col("per_char").alias("bits_per_char"),
                         F.pow(F.lit(2.0), F.col("per_char")).alias("perplexity"), "threshold",
                         (~F.coalesce(over, F.lit(False))).alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rejected ones; a row with a null id stays, rows that repeat an id go together if one of them is rejected."""
    return without_ids(docs, id_col, classify(docs, labels, id_col, **options).filter(~F.col("accepted")).select(id_col))
