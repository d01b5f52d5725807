"""Greedy chains against a plain walk."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan.operators import policies as P
from idlespan.operators import severity as V
from idlespan.operators.chains import greedy_chain, with_spacing
from idlespan.scale import Splits

SCHEMA = "path string, id int, at long, until long"


def walk(rows):
    """Chosen ids; rows with equal times go in the order of their ids."""
    out, free = [], {}
    for path, i, at, until in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[2], r[1])):
        if path not in free or at >= free[path]:
            out.append(i)
            free[path] = max(at, until if until is not None else at)
    return sorted(out)


def many(rng, n, paths, span, length):
    rows = []
    for i in range(n):
        at = rng.randrange(span)
        rows.append((rng.choice(paths), i, at, at + rng.randrange(-2, length)))
    return rows + [("a", n, None, 5), ("b", n + 1, 7, None)]


@pytest.mark.parametrize("splits", [None, Splits((300.0, 800.0, 801.0))])
@pytest.mark.parametrize("n, span, length", [(500, 1000, 1), (300, 1000, 40), (300, 100_000, 40), (200, 1000, 2000)])
def test_chains(frame, splits, n, span, length):
    rows = many(random.Random(n + length), n, "aaab", span, length)
    got = greedy_chain(frame(rows, SCHEMA), ["path"], "at", F.col("until"), "kept", ["id"], splits)
    assert got.columns == ["path", "id", "at", "until", "kept"] and got.count() == len(rows)
    assert [i for i, in rows_of(got.filter("kept"), "id")] == walk(rows)


def test_one_long_chain_of_one_path(frame):
    """Every row overlaps the next: all are pointers to rows that only the chain can choose."""
    rows = [("a", i, 10 * i, 10 * i + 25) for i in range(3000)]
    got = greedy_chain(frame(rows, SCHEMA), ["path"], "at", F.col("until"), splits=Splits((7000.0, 15_000.0, 22_000.0)))
    assert [i for i, in rows_of(got.filter("chosen"), "id")] == list(range(0, 3000, 3))


def test_only_placed_probes_block(frame):
    rows = [("p", "a", 0, 0, 100), ("p", "a", 1, 50, 150), ("p", "a", 2, 120, 220), ("q", "a", 1, 50, 150), ("p", "b", 1, 50, 150)]
    placed = frame(rows, "policy string, path string, gap_idx int, scheduled_ns long, end_ns long")
    kept = P.one_per_path_at_a_time(placed, ["path"])
    assert rows_of(kept, "policy", "path", "gap_idx") == [("p", "a", 0), ("p", "a", 2), ("p", "b", 1), ("q", "a", 1)]
    assert kept.columns == placed.columns


def test_spacing_without_a_key(frame):
    rng = random.Random(6)
    times = [rng.randrange(20_000) for _ in range(300)]
    got = V.cooldown(frame([(t, t + 1) for t in times], "start_ns long, end_ns long"), 400, minimum=True)
    want, last = [], None
    for t in sorted(times):
        if last is None or t >= last + 400:
            want.append((t,))
            last = t
    assert rows_of(got, "start_ns") == want
    assert with_spacing(frame([], SCHEMA), 5, ["path"], "at").count() == 0
