"""Merged quantile sketches and kept histograms against the rows themselves."""

import random
from bisect import bisect_left, bisect_right

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan.operators.aggregates import gap_stats
from idlespan.operators.sketches import merge_sketches, quantile_sketches, rank_error, sketched_quantiles

PS = (0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("items", [100, 400])
def test_ranks_of_merged_sketches(frame, items):
    rnd = random.Random(items)
    rows = [(rnd.choice("aab"), i % 9, rnd.choice([rnd.gauss(0, 1), 3.0, rnd.expovariate(0.01)])) for i in range(30_000)]
    df = frame([*rows, ("a", 1, None), ("c", 1, None)], "path string, pass int, v double")
    merged = merge_sketches(quantile_sketches(df, "v", ["path", "pass"], items), ["path"])
    for path, p, n, value in rows_of(sketched_quantiles(merged, ["path"], PS), "path", "p", "n", "value"):
        values = sorted(v for q, _, v in rows if q == path)
        assert n == len(values)
        below, upto = bisect_left(values, value) / n, bisect_right(values, value) / n
        assert below - rank_error(items) <= p <= upto + rank_error(items)
        if p in (0.0, 1.0):
            assert value == values[-int(p)]
    assert {r.path for r in merged.collect()} == {"a", "b"}


def test_a_histogram_reads_as_its_rows(frame):
    rnd = random.Random(1)
    gaps = frame([(rnd.choice("ab"), rnd.randrange(40)) for _ in range(500)], "path string, duration_ns long")
    hist = gaps.groupBy("path", "duration_ns").agg(F.count(F.lit(1)).alias("n"))
    whole, kept = gap_stats(gaps, ["path"], at_least={"long": 30}), gap_stats(hist, ["path"], at_least={"long": 30}, weight="n")
    assert rows_of(whole, *whole.columns) == rows_of(kept, *whole.columns)
