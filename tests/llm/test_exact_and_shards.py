"""Exact dedup and sharding against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from idlespan.llm import exact_dedup, jump_shards

SCHEMA = "doc_id long, text string, keep_id string, digest int, shard string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def make(rng, n):
    texts = [None, "", "Same Text", "same text", "ÄÖ", "äö", "x" * 200_000, "a b", "A  b"] + [f"t{i}" for i in range(20)]
    rows = [(i, rng.choice(texts), "x", 1, None) for i in range(n)]
    return rows + rows[:3] + [(None, "same text", None, None, None), (None, "only null", None, None, None)]


def groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[low(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = by[low(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(low(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, weak):
    rows = make(random.Random(1), 150)
    options = {"digest": lambda t: F.sha2(F.substring(t, 1, 1), 256)} if weak else {}      # digests that collide
    got = exact_dedup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), salts=3, **options).collect()
    want = groups(rows)
    if weak:
        got, want = [tuple(r)[:4] for r in got], [w[:4] for w in want]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_keep_one(spark):
    rows = make(random.Random(2), 150)
    got = exact_dedup.keep_one(spark.createDataFrame(rows, SCHEMA), salts=3)
    assert got.columns == ["doc_id", "text", "keep_id", "digest", "shard"]
    kept = got.collect()
    assert sorted(low(r.text) for r in kept) == sorted({low(r[1]) for r in rows})
    assert {(r.doc_id, low(r.text)) for r in kept} == {(g[0], low(r[1])) for r in rows for g in groups([x for x in rows if low(x[1]) == low(r[1])]) if g[3]}


def jump(key, n):
    key &= 2**64 - 1
    at, nxt = -1, 0
    while nxt < n:
        at = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash(spark):
    rng = random.Random(3)
    keys = [0, 1, -1, 2**63 - 1, -2**63, *[rng.randrange(-2**63, 2**63) for _ in range(500)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        assert [tuple(r) for r in df.select("k", jump_shards.jump_hash(F.col("k"), n)).collect()] == \
            [(k, jump(k, n)) for k in keys]


def test_shards(spark):
    rows = make(random.Random(4), 400)
    got = jump_shards.assign_shards(spark.createDataFrame(rows, SCHEMA), 8, block_rows=20).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law) for r in got) == \
        sorted((str(r[0]), size(r[1]), zlib.crc32((r[1] or "").encode()), "key") for r in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 8) and r.grown_shard == jump(r.doc_id or 0, 9)
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0
    assert jump_shards.assign_shards(none, 8).count() == 0
