"""The language model against a plain implementation, and its decisions on held-out labels."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlespan.llm import kneser_ney as KN

DOCS = "doc_id long, text string, lang string, bits string, chunk int, threshold string"
LABELS = "doc_id long, quality int, toxic int"


def code(text):
    return [0, 0, *[65535 if ord(c) == 0 or ord(c) > 65535 else ord(c) for c in text or ""]]


def trigrams(text):
    c = code(text)
    return [tuple(c[i - 2:i + 1]) for i in range(2, len(c))]


def brute(train):
    """A function from a trigram to its probability."""
    counts = {3: Counter(g for t in train for g in trigrams(t))}
    for k in (2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, ctx = {}, {}
    for k in (1, 2, 3):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        exact = [j - (j + 1) * y * n[j + 1] / n[j] if y is not None and n[j] else 0 for j in (1, 2, 3)]
        off[k] = [0.0] + [d if 0 < d <= j else j / 2 for j, d in zip((1, 2, 3), exact)]
        ctx[k] = defaultdict(list)
        for g, a in counts[k].items():
            ctx[k][g[:-1]].append(a)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 65536
        k, seen = len(g), ctx[len(g)].get(g[:-1])
        if not seen:
            return below
        a = counts[k][g]
        spread = sum(off[k][min(x, 3)] for x in seen)
        return (max(a - off[k][min(a, 3)], 0) + spread * below) / sum(seen)
    return p


def test_bits_equal_a_plain_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [None, "", "a", "a\0b", "🙂 smile 🙃", "漢字" * 20, "zzz", "x" * 50_000]
    rows = [(i, t, rng.choice(["en", None, "fr"]), None, None, None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "abc", "en", None, None, None), (900, "no model", "xx", None, None, None)]
    good = {i for i in range(len(texts)) if i % 2}
    got = KN.perplexities(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in good], "id long"),
                          chunk_bytes=3000).collect()
    want = []
    for lang in ("en", None, "fr", "xx"):
        own = [r for r in rows if r[2] == lang]
        p = brute([r[1] for r in own if r[0] in good])
        want += [(str(r[0]), lang or "", len(r[1] or ""), round(-sum(math.log2(p(g)) for g in trigrams(r[1])), 4)) for r in own]
    assert sorted((str(r.id), r.lang, r.n_chars, round(r.bits, 4)) for r in got) == sorted(want)


def test_many_symbols_take_the_sorted_way():
    texts = ["".join(chr(0x4E00 + i) for i in range(900)), "", "ab"]
    c = KN.coded(texts)
    assert len(c.symbols) ** 3 > KN.DENSE
    keys = c.key(c.gram).tolist()
    assert keys == [a << 32 | b << 16 | d for t in texts for a, b, d in trigrams(t)]
    assert set(c.key(c.different()).tolist()) == set(keys)


def test_held_out_labels(spark):
    """Trained on four fifths of the labels, the rest is told apart."""
    try:
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("driver tables are not here")
    out = KN.classify(docs, labels.filter("doc_id % 5 > 0")).join(labels.filter("doc_id % 5 = 0"), "doc_id")
    share = dict(out.filter("toxic = 0").groupBy("quality").agg(F.avg(F.col("accepted").cast("double"))).collect())
    assert share[1] >= 0.97 and share[0] <= 0.5


def test_the_quantile_is_the_threshold(spark):
    """Nothing over the language's quantile stays."""
    try:
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("driver tables are not here")
    over = (F.col("n_chars") > 0) & (F.col("bits_per_char") - KN.SHORT / F.sqrt("n_chars") > F.col("threshold") + 1e-9)
    out = KN.classify(docs, labels).filter("threshold is not null").groupBy(over.alias("over"), "accepted").count().collect()
    assert {(r.over, r.accepted) for r in out} == {(False, True), (True, False)}


def test_rejected_go(spark):
    rows = [(i, "some plain words and more plain words here" + " again" * (i % 5), "en", None, None, None) for i in range(40)]
    rows += [(50, "%$#@ " * 30, "en", None, None, None), (None, "%$#@ " * 30, "en", None, None, None), (51, None, "en", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(50, 0, 0), (None, 1, 0), (51, None, None)], LABELS)
    kept = KN.keep_accepted(df, labels)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] != 50)


def test_empty(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert KN.classify(none, no_labels).count() == 0
    some = spark.createDataFrame([(1, "abc", "en", None, None, None)], DOCS)
    assert KN.classify(some, no_labels).first().accepted


def test_coding_a_chunk_takes_few_bytes_a_character():
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(32, 150, 4000))) for _ in range(2000)]
    tracemalloc.start()
    try:
        c = KN.coded(texts)
        n = len(c.different())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 1_000_000 and len(c.gram) == 8_000_000 and peak < 16 * len(c.gram)
