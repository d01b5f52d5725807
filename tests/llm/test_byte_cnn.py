"""The byte network against plain loops, finite differences and held-out accuracy."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlespan.llm import byte_cnn as B

SCHEMA = "doc_id long, text string, lang string, lang_pred string, held_out int, rows int, b string"
WORDS = {"xx": "bado keru mito sanale toru pike".split(), "yy": "schtung weifer blochen unter grast".split(),
         "": "łąka źdźbło ćma żółw".split()}


def plain(net, data):
    """Every window and filter by loops."""
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    w, total, weight = net.weights, 0, 0
    for at in range(0, max(1, len(data)), B.STEP):
        window = data[at:at + B.WINDOW].ljust(B.WINDOW, b"\0")
        x = w["embedding"][list(window)]
        pooled = []
        for f in range(B.FILTERS * len(B.WIDTHS)):
            width = B.WIDTHS[f // B.FILTERS]
            kernel = w["filters"][:width * B.EMBEDDING, f].reshape(width, B.EMBEDDING)
            pooled.append(max((x[i:i + width] * kernel).sum() for i in range(B.WINDOW - max(B.WIDTHS) + 1)))
        z = np.maximum(np.array(pooled) + w["bias"], 0) @ w["top"] + w["offset"]
        p = np.exp(z - z.max())
        own = max(1, min(len(data) - at, B.STEP))
        total, weight = total + own * p / p.sum(), weight + own
    return total / weight


def test_probabilities_of_whole_texts():
    net, rng = B.ByteNet(["a", "b", "c"]), random.Random(1)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (1, 2, 5, 251, 252, 253, 256, 257, 503, 504, 505, 760)] + [b"ABC abc"]
    got = B.mean_probabilities(net, texts)
    for row, text in zip(got, texts):
        assert np.allclose(row, plain(net, text), atol=1e-4)
    assert np.allclose(got[0], B.mean_probabilities(net, texts[:1])[0], atol=1e-6)


def test_gradients():
    rng = np.random.default_rng(2)
    net, labels = B.ByteNet(["a", "b", "c"]), rng.integers(0, 3, 5)
    windows = rng.integers(1, 256, (5, B.WINDOW)).astype(np.uint8)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()
    for name, g in net.gradients(windows, labels).items():
        flat, held = net.weights[name].reshape(-1), g.reshape(-1)
        for i in np.argsort(-abs(held))[:4]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            assert held[i] == pytest.approx((up - loss()) / 2e-5, rel=1e-2)
            flat[i] = old


def make(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 200)))
        rows.append((i, text, lang, "q", 1, 2, None))
    odd = [None, "", "12 345 !?", "²½ ©", "z"]
    return rows + [(n + i, t, "xx", None, None, None, None) for i, t in enumerate(odd)] + \
        [(n + 9, rows[0][1], None, None, None, None, None), rows[3], (None, rows[1][1], rows[1][2], None, None, None, None),
         (n + 10, "bado keru mito " * 20_000, None, None, None, None, None)]


def test_languages(spark):
    rows = make(random.Random(3), 240)
    got = B.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted(
        (str(r[0]), zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 == 1) for r in rows)
    known = {r[0]: r for r in rows}
    for r in got:
        text = known[r.doc_id][1]
        assert 0 <= r.score <= 1
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in WORDS
    right = [r.lang_pred == known[r.doc_id][2] for r in got if r.held_out and r.doc_id < 240]
    assert len(right) > 50 and np.mean(right) > 0.97


def test_what_is_learnt_from(spark):
    """Neither a held-out label nor the sample bound lets anything else in."""
    rows = [(i, "abc def ghi " * (i % 40 + 1), "in" if zlib.crc32(str(i).encode()) % 3 != 1 else "out", None, None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sample = B.training_sample(docs, ~B.held_out(), sample=50).collect()
    assert len(sample) == 50 and {r.lang for r in sample} == {"in"} and all(0 < len(r.bytes) <= B.WINDOW for r in sample)
    assert {r.lang_pred for r in B.identify(docs).collect()} == {"in"}


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, None, None, None, None), (3, None, "xx", None, None, None, None)]])
def test_nothing_to_learn(spark, rows):
    got = B.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0)] * len(rows)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = B.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
