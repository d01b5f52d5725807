"""Sliding quantiles against Spark's own percentile over the same frames."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from idlespan.operators import sliding
from idlespan.operators.sliding import sliding_quantiles
from idlespan.scale import Splits

SCHEMA = "path string, i long, x long, note string"


def make(seed):
    rnd = random.Random(seed)
    rows = [(p, i, rnd.choice([None, *[rnd.randrange(10**12)] * 9]), "n") for p, n in (("a", 700), ("b", 3), ("c", 260), ("d", 1)) for i in range(n)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("causal", [True, False])
@pytest.mark.parametrize("lookback, splits, chunk", [(100, None, 1), (7, None, 1), (20, Splits((5.0,)), 64), (20, Splits((5.0,)), 3), (1, Splits((5.0,)), 100)])
def test_equals_percentile(frame, monkeypatch, causal, lookback, splits, chunk):
    monkeypatch.setattr(sliding, "ROWS", 50)
    df = frame(make(lookback), SCHEMA)
    w = Window.partitionBy("path").orderBy("i")
    w = w.rowsBetween(-lookback, -1) if causal else w.rowsBetween(-(lookback - 1), 0)
    want = df.select("path", "i", "note", F.percentile("x", 0.1).over(w).alias("low"), F.percentile("x", 0.5).over(w).alias("mid"), F.count("x").over(w).alias("n"))
    got = sliding_quantiles(df, ["path"], "i", "x", {"low": 0.1, "mid": 0.5}, lookback, causal, splits, chunk, "n")
    assert got.columns == ["path", "i", "x", "note", "low", "mid", "n"]
    assert [str(r) for r in rows_of(got, *want.columns)] == [str(r) for r in rows_of(want, *want.columns)]


def test_without_a_key_and_empty(frame):
    df = frame([("a", i, 10 * i, None) for i in range(6)], SCHEMA)
    assert rows_of(sliding_quantiles(df, [], "i", "x", {"m": 0.5}, 2), "i", "m", "_n") == [
        (0, None, 0), (1, 0.0, 1), (2, 5.0, 2), (3, 15.0, 2), (4, 25.0, 2), (5, 35.0, 2)]
    assert sliding_quantiles(df.limit(0), ["path"], "i", "x", {"m": 0.5}, 2).count() == 0
