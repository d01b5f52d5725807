"""Raking against its own goals and a plain loop, top-k search against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from idlespan.llm import maxscore, raking

DOCS = "doc_id long, text string, source string, lang string, topic string, tokens string, weight int, id int"


def corpus(rng, n):
    texts = [None, "", "free license text", "write to a@b.c", "x | y | z", "word " * 3000]
    return [(i, rng.choice(texts) if rng.random() < 0.3 else "plain words " * rng.randrange(1, 60),
             rng.choice([None, "s0", "s0", "s0", "s1", "s2"]), rng.choice(["en", "en", "fr", None]), "own", None, 1, 2) for i in range(n)]


def test_margins_meet_their_targets(spark):
    docs = spark.createDataFrame(corpus(random.Random(1), 500), DOCS)
    goal = {"source": {"s0": 1.0, "s1": 2.0, "s2": 1.0}, "lang": {"en": 1.0, "fr": 1.0}}
    targets = {m: spark.createDataFrame(list(g.items()), f"{m} string, share double") for m, g in goal.items()}
    rows = raking.described(docs)
    cells = raking.rake(raking.counted(rows, list(goal), "tokens"), targets, 40).collect()
    total = sum(c.tokens for c in cells)
    for m in goal:
        weight, tokens = defaultdict(float), defaultdict(int)
        for c in cells:
            weight[c[m]] += c.weight
            tokens[c[m]] += c.tokens
        asked = {v: goal[m][v] / sum(goal[m].values()) if v in goal[m] else tokens[v] / total for v in tokens}
        for v in asked:
            assert weight[v] / sum(weight.values()) == pytest.approx(asked[v] / sum(asked.values()), rel=1e-3)


@pytest.mark.parametrize("keep", [0.3, 0.6])
def test_shares_of_what_is_drawn(spark, keep):
    """After the bound on every cell: values that can reach their share do, the others give all, and the rest is shared in proportion."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice("aaaaaaaabbbc"), rng.choice(["en"] * 6 + ["fr", "de"]), *[None] * 4) for i in range(3000)]
    goal = {"source": {"a": 1.0, "b": 1.0, "c": 1.0}, "lang": {"en": 2.0, "fr": 1.0, "de": 1.0}}
    targets = {m: spark.createDataFrame(list(g.items()), f"{m} string, share double") for m, g in goal.items()}
    found = raking.mixed(spark.createDataFrame(rows, DOCS), keep, targets=targets, passes=60).collect()
    total = sum(r.tokens for r in found)
    for m, asked in goal.items():
        held, kept = defaultdict(float), defaultdict(float)
        for r in found:
            held[r[m]] += r.tokens / total
            kept[r[m]] += r.tokens * r.probability / (keep * total)
        want = {v: s / sum(asked.values()) for v, s in asked.items()}
        for _ in want:
            full = {v for v in want if want[v] >= held[v] / keep}
            rest = (1 - sum(held[v] / keep for v in full)) / sum(want[v] for v in want if v not in full)
            want = {v: held[v] / keep if v in full else want[v] * rest for v in want}
        assert dict(kept) == pytest.approx(want, rel=0.02)


def test_few_cells_are_raked_by_few_jobs(spark, monkeypatch):
    """A job per exchange and broadcast costs the driver memory; more cells than one task takes are raked alike."""
    docs, context, found = spark.createDataFrame(corpus(random.Random(4), 300), DOCS), spark.sparkContext, []
    for most in (raking.ONE_TASK, 0):
        monkeypatch.setattr(raking, "ONE_TASK", most)
        context.setJobGroup(f"raking-{most}", "")
        rows = raking.mixed(docs).collect()
        found.append(({r.doc_id: r.selected for r in rows}, {r.doc_id: r.probability for r in rows}))
        if most:
            assert len(context.statusTracker().getJobIdsForGroup(f"raking-{most}")) <= 60
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1], rel=1e-9)


def test_reached_shares(spark):
    cells = spark.createDataFrame([("a", 10, 1.0), ("b", 30, 0.5), ("b", 10, 0.5)], "source string, tokens long, probability double")
    shares = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, share double")
    got = {r.value: (r.target, r.reached) for r in raking.reached_shares(cells, {"source": shares}).collect()}
    assert got == {"a": (0.75, pytest.approx(1 / 3)), "b": (0.25, pytest.approx(2 / 3))}


@pytest.mark.parametrize("keep", [0.3, 0.8, 1.0])
def test_probabilities_expect_the_budget(spark, keep):
    docs = spark.createDataFrame(corpus(random.Random(2), 400), DOCS)
    rows = raking.mixed(docs, keep).collect()
    assert len(rows) == 400
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(keep * sum(r.tokens for r in rows), rel=1e-6)
    assert all(0 < r.probability <= 1 and (r.selected or r.tokens > 0) for r in rows)
    factor = {round(r.probability / r.weight, 6) for r in rows if r.tokens and r.probability < 1}
    assert len(factor) <= 1                                                    # calibrated: one factor below 1
    share = sum(r.selected for r in rows if r.tokens) / sum(r.probability for r in rows if r.tokens)
    assert share == pytest.approx(1, abs=0.15)


def test_sample_keeps_rows_as_they_came(spark):
    rows = corpus(random.Random(3), 200)
    rows += [rows[0], (None, "a b c", "s1", "en", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = raking.sample(df)
    assert got.columns == df.columns
    chosen = {r.doc_id for r in raking.mixed(df).filter("selected").collect()}
    assert sorted(map(str, got.collect())) == sorted(map(str, df.filter(F.coalesce(F.col("doc_id"), F.lit(-1)).isin(
        [-1 if c is None else c for c in chosen])).collect()))


VECTORS = "vec_id long, embedding array<float>, score string, rank string, id int, dims int"


def vectors(rng, n):
    out = [(i, [rng.gauss(0, 1) for _ in range(16)], None, None, 1, 2) for i in range(n)]
    out += [(n + i, out[7][1], None, None, 1, 2) for i in range(40)]           # one very common vector
    bad = [None, [], [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [3.0, -1.0], [2.0] * 16, [-1e6] * 16]
    out += [(1000 + 50 * i, v, None, None, 1, 2) for i, v in enumerate(bad)] + [(None, [1.0] * 16, None, None, 1, 2), out[50], out[3]]
    return out


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict(reversed([g for g in good if g[0] % 50 == 0])).items():
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 60, 8192])
def test_top_k(spark, shard):
    rows = vectors(random.Random(shard), 300)
    df = spark.createDataFrame(rows, VECTORS)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]                     # as 32-bit floats
    got = maxscore.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_queries=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_bounds_leave_vectors_out():
    """With a few heavy terms most vectors are given up before the light terms are probed."""
    import numpy as np
    rng = np.random.default_rng(5)
    postings = np.abs(rng.normal(size=(32, 4000)) * np.r_[np.full(4, 200.0), np.full(28, 2.0)][:, None]).round()
    query = np.ones(32)
    at, scores = maxscore.best(postings, query, 5)
    exact = query @ postings
    assert set(np.argsort(-exact)[:5]) <= set(at.tolist()) and len(at) < 400
    assert (scores == exact[at]).all()


def test_empty(spark):
    assert raking.mixed(spark.createDataFrame([], DOCS)).count() == 0
    assert raking.sample(spark.createDataFrame([], DOCS)).count() == 0
    assert maxscore.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
