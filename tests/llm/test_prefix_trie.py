"""The prefix trie against a plain one of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from idlespan.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string, conv string, pos int, w1 string, weight int, depth int, _seg int"


def key(row):
    role, text = row[2] or "", row[3] or ""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (row[1] is not None, row[1] or 0, role, digest)


def remainder(a, n):
    return a - n * int(a / n)


def rebuilt(rows):
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    turns = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=key)] for c, rs in by.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - remainder(c, 5), [])[:h] + own[h:]
    return out


def plain(rows):
    members = defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    total = defaultdict(lambda: [0, 0])
    for p, m in members.items():
        for d in range(len(p) + 1):
            total[p[:d]][0] += not children[p]
            total[p[:d]][1] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(p)))
        out.append((min(c for c, _ in m), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(m), len(children[p]),
                    *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def make(rng, n, low=0):
    rows = []
    for c in rng.sample(range(low, low + 2 * n), n):
        kind = rng.random()
        turns = rng.choice((0, 1, 1, 2, 3, 9, 12)) if kind < 0.8 else 5
        for t in range(turns):
            text = rng.choice(["hi", "Hé", "", None]) if kind < 0.8 else f"same {t}"
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "bot", None]) if kind < 0.8 else "user", text,
                         "x", 1, "w", 2, 3, 4))
    return rows + rows[:3] + [(None, 0, "user", "nobody", *[None] * 6)]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed, low", [(1, 0), (2, -40), (3, 1000)])
def test_nodes(spark, seed, low):
    rows = make(random.Random(seed), 60, low)
    got = T.trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_heavy_conversation_and_ends_in_parts(spark):
    rng = random.Random(4)
    rows = make(rng, 30) + [(c, t, "user", f"same {t}", *[None] * 6) for c in range(100, 200) for t in range(3)]
    rows += [(500, t, "user", f"long {t % 7}", *[None] * 6) for t in range(400)] + [(505, t, "user", f"long {t % 7}", *[None] * 6) for t in range(250)]
    rng.shuffle(rows)
    got = T.trie(spark.createDataFrame(rows, SCHEMA), most_rows=60, ends_part=11).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_last_turns(spark):
    rows = make(random.Random(5), 25)
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = rebuilt(rows)
    for r in T.last_turns(T.trie(docs), docs).collect():
        assert whole[r.conv_id][r.depth - 1] == (r.role, r.text)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b", *[None] * 6)], [(7, None, None, None, *[None] * 6)],
                                  [(2**63 - 1, 1, "a", "b" * 50_000, *[None] * 6), (-2**63, 1, "a", "b", *[None] * 6)]])
def test_small(spark, rows):
    got = T.trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    if rows and rows[0][0] and abs(rows[0][0]) > 2**60:
        assert len(got) >= 1
    else:
        assert sorted(map(tuple, got), key=str) == plain(rows)
