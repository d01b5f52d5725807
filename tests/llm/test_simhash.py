"""SimHash, bit-sliced links and near-copy groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from idlespan.llm import simhash
from idlespan.llm.components import components

SCHEMA = "doc_id long, text string, fingerprint int, component_id string, node string, label string"


def prose(rng, n):
    return " ".join(rng.choice("the of and cat dog sun moon tree river stone bird fish leaf road hill".split()) + str(rng.randrange(9))
                    for _ in range(n))


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
    return " ".join(w)


def corpus(rng, n):
    base = [prose(rng, rng.choice([3, 40, 120])) for _ in range(n)]
    near = [edited(rng, rng.choice(base), rng.choice([0, 1, 2])) for _ in range(n)]
    odd = [None, "", " \t\n", "one", "One", "two words", "x" * 300_000, "a b   c", "Ä ä É"]
    texts = base + near + odd + odd
    rng.shuffle(texts)
    rows = [(i, t, None, None, None, "c") for i, t in enumerate(texts)]
    return rows + rows[:2] + [(None, base[0], None, None, None, None)]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out


def shingles(text, k):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("cell", [4, 2048])
def test_components_of_links(spark, cell):
    rows = corpus(random.Random(cell), 60)
    prints = [fingerprint(r[1]) for r in rows]
    roots = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    lowest = {g: min((r[0] for r, h in zip(rows, roots) if h == g and r[0] is not None), default=None) for g in set(roots)}
    got = simhash.near_components(spark.createDataFrame(rows, SCHEMA), cell=cell).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(r[0], f"{p:016x}", lowest[g]) for r, p, g in zip(rows, prints, roots)], key=str)


def test_near_pairs_of_random_bits():
    rng = np.random.default_rng(1)
    for bits, radius in ((64, 2), (64, 5), (128, 34)):
        n = 300
        prints = rng.integers(0, 2**63, (n, bits // 64), dtype=np.uint64)
        for i in range(150, n):                                                # copies with some bits flipped
            prints[i] = prints[i - 150]
            for b in rng.integers(0, bits, rng.integers(0, radius + 3)):
                prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        group = np.sort(rng.integers(0, 3, n))
        got = {(int(i), int(j)) for a, b in simhash.near_pairs(prints, group, radius) for i, j in zip(a, b)}
        far = lambda i, j: sum((int(x) ^ int(y)).bit_count() for x, y in zip(prints[i], prints[j]))
        assert got == {(i, j) for j in range(n) for i in range(j) if group[i] == group[j] and far(i, j) <= radius}


def test_banded_tables_find_every_pair():
    rng = random.Random(2)
    tables = [t[0] for t in simhash.banded_tables(2)]
    assert len(tables) == 10
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        assert any(a & m == b & m for m in tables)


@pytest.mark.parametrize("block", [4, 256])
def test_keep_one_near(spark, block):
    rng = random.Random(block)
    rows = corpus(rng, 40) + [(1000 + i, edited(rng, prose(random.Random(7), 200), 1), None, None, None, None) for i in range(20)]
    sets = [set(shingles(r[1], 5)) for r in rows]

    def close(i, j):
        return len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    roots = groups(len(named), lambda i, j: rows[named[i]][0] == rows[named[j]][0] or close(named[i], named[j]))
    lowest = {}
    for i, g in zip(named, roots):
        lowest[g] = min(lowest.get(g, 10**9), rows[i][0])
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.keep_one_near(df, block=block)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert {i for i in ids if i is not None} == set(lowest.values())
    assert ids.count(None) == 1


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(3)
    names = rng.sample(range(-10**6, 10**6), 300)
    edges = list(zip(names[:200], names[1:200])) + [(names[200], x) for x in names[201:]] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {x: min(names[:200]) for x in names[:200]} | {x: min(names[200:]) for x in names[200:]}
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_components(none).count() == 0
    assert simhash.keep_one_near(none).count() == 0


@pytest.mark.parametrize("cell", [8, 2048])
def test_every_pair_at_the_similarity_is_linked(spark, cell):
    """4 of 5 shingles, which differ in size class and often in most tables, and pairs that share a common line."""
    rng = random.Random(5)
    line = "this line stands in a third of all texts as it is"
    texts = []
    for i in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8] if i % 2 else words[1:])]
        if i % 3 == 0:
            texts += [f"{line} " + " ".join(words[::-1][:5]), f"{line} {words[3]}", f"{line} {words[4]}"]
    sets = [set(shingles(t, 5)) for t in texts]
    roots = groups(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one_near(rows, cell=cell).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(roots))
