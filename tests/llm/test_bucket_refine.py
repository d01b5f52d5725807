"""Removed substrings against a dictionary of all of them."""

import hashlib
import random

import numpy as np
import pytest

from idlespan.llm import bucket_refine as B

SCHEMA = "doc_id long, text string, spans string, chunk int, data string, id string"


def brute(rows, length):
    texts = [(10**18 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            s = t[i:i + length]
            least[s] = min(d, least.get(s, d))
    out = []
    for (d, t), r in zip(texts, rows):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            i += 1
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((str(r[0]), len(t), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def corpus(rng, n):
    letters = "abcdefgh "
    make = lambda k, kind=letters: "".join(rng.choice(kind) for _ in range(k))
    shared = [make(50), make(51), make(49), make(400), "é" * 40, "line of text that is very common in this corpus, yes it is\n"]
    rows = []
    for i in range(n):
        parts = [make(rng.randrange(0, 120)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append(["".join(parts)])
    base = make(3000)
    texts = [r[0] for r in rows] + [None, "", base, base, base.upper(), base[:1500] + "X" + base[1500:], "a" * 49, "a" * 50, "a" * 500, "ab" * 300,
                                    make(30, "x") + base[100:149], base[100:150], make(20_000, "ab")]
    texts += [texts[-1][5000:15_000]] + [shared[-1] * 3] * 3
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(3 * i - 20, t, None, 1, None, "y") for i, t in zip(ids, texts)]
    return rows + [rows[0], rows[5], (None, base, None, None, None, None), (None, base, None, None, None, None), (rows[3][0], "other " + base[:80], None, 1, None, None)]


@pytest.mark.parametrize("chunk_bytes,segment,length", [(20_000, 1 << 20, 50), (2000, 700, 50), (8000, 300, 64), (1 << 20, 5000, 40)])
def test_removed_bytes(spark, monkeypatch, chunk_bytes, segment, length):
    rows = corpus(random.Random(chunk_bytes), 60)
    got = B.repeated_spans(spark.createDataFrame(rows, SCHEMA), length, texts=True, chunk_bytes=chunk_bytes).collect()
    assert sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256, bytes(r.kept)) for r in got) == brute(rows, length)


@pytest.mark.parametrize("segment", [60, 300, 1 << 20])
def test_segments_find_the_same_windows(monkeypatch, segment):
    import pyarrow as pa
    monkeypatch.setattr(B, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (49, 50, 51, 333, 2000)]
    chunk = B.Chunk(pa.table({"id": range(5), "data": texts}), B.NOTE.empty_table(), 50)
    seen = []
    for data, doc, shift, place, first, last, _ in chunk.contexts(all_buckets=True):
        for d, s, p, a, b in zip(doc, shift, place, first, last):
            assert a <= p <= a + 34 and b <= p and data[a:b + 50] == texts[d][a + s:b + s + 50]
            seen += [(d, x + s) for x in range(a, b + 1)]
    assert sorted(seen) == [(d, x) for d, t in enumerate(texts) for x in range(len(t) - 49)]


def test_refined_buckets():
    rng = np.random.default_rng(1)
    pool = rng.integers(97, 100, 3000).astype(np.uint8)
    pool[1500:1700] = pool[100:300]
    room = len(pool) - np.arange(len(pool))
    got = B.refined(pool, room, 50)
    text = pool.tobytes()
    by = {}
    for i in range(len(text) - 49):
        by.setdefault(text[i:i + 50], []).append(i)
    for places in by.values():
        assert len({int(got[i]) for i in places}) == 1 and (got[places[0]] >= 0) == (len(places) > 1)
    assert len(set(got[got >= 0].tolist())) == sum(len(p) > 1 for p in by.values())


def test_empty(spark):
    assert B.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("crowd,chunk_bytes,length", [(0, 20_000, 50), (3, 2000, 50), (3, 8000, 40)])
def test_crowded_buckets_lose_the_same_bytes(spark, crowd, chunk_bytes, length):
    rng = random.Random(crowd + chunk_bytes)
    rows = corpus(rng, 60)
    phrase = "a phrase that is shorter than "
    rows += [(5000 + i, "".join(rng.choice("abc") for _ in range(rng.randrange(30))) + phrase + rng.choice(["xyz", "yx"]) * 9, None, 1, None, None)
             for i in range(40)]
    got = B.repeated_spans(spark.createDataFrame(rows, SCHEMA), length, texts=True, chunk_bytes=chunk_bytes, crowd=crowd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256, bytes(r.kept)) for r in got) == brute(rows, length)


def test_a_frequent_phrase_is_dealt_over_the_shards():
    """Every document has its own bytes around one phrase; no shard gets a context of each."""
    import pyarrow as pa
    rng = random.Random(3)
    phrase = b"a phrase of 16 to 49 bytes in all texts"
    texts = [bytes(rng.choices(range(97, 123), k=60)) + phrase + bytes(rng.choices(range(97, 123), k=60)) for _ in range(2000)]
    docs, key = pa.table({"id": range(2000), "data": texts}), (pa.scalar(0, pa.int32()),)
    sent = B._send_buckets(50, 16)(key, docs, B.NOTE.empty_table()).to_pylist()
    notes = pa.concat_tables([B._shared_buckets(500)(None, pa.Table.from_pylist([m], schema=B.MAIL)) for m in sent])
    size = np.zeros(16)
    for m in B._send_contexts(50, 16)(key, docs, notes).to_pylist():
        size[m["shard"]] += len(m["data"])
    assert size.max() < 2 * size.mean()


def test_what_shares_only_an_anchor_is_not_sent():
    """Texts of few syllables share most of their 16-byte strings and hardly a window: what leaves a chunk does not grow with the others."""
    import pyarrow as pa
    rng = random.Random(5)
    syllables = "the er ing on".split()
    common = "a line that stands in every text and is a good deal longer than fifty bytes, "
    texts = [("".join(rng.choice(syllables) for _ in range(400)) + common * (i % 10 == 0)).encode() for i in range(2000)]
    docs, key = pa.table({"id": range(2000), "data": texts}), (pa.scalar(0, pa.int32()),)
    sent = B._send_buckets(50, 8)(key, docs, B.NOTE.empty_table()).to_pylist()
    notes = pa.concat_tables([B._shared_buckets(10_000)(None, pa.Table.from_pylist([m], schema=B.MAIL)) for m in sent])
    grams = [t[i:i + 16] for t in texts for i in range(0, len(t) - 15, 50)]
    assert len(set(grams)) < 0.7 * len(grams)
    assert sum(len(m["data"]) for m in B._send_contexts(50, 8)(key, docs, notes).to_pylist()) < 0.05 * sum(map(len, texts))


@pytest.mark.parametrize("length", [32, 40, 50, 64, 97])
def test_equal_windows_have_equal_buckets(length):
    rng = random.Random(length)
    shared = bytes(rng.choices(b"abcd", k=3 * length))
    data = np.frombuffer(b"".join(bytes(rng.choices(b"abcd", k=rng.randrange(60))) + shared for _ in range(20)), np.uint8)
    _, first, last, bucket, _ = B.anchors(data, np.arange(len(data) - length + 1), length)
    assert first[0] == 0 and last[-1] == len(data) - length and (first[1:] == last[:-1] + 1).all()
    text, by = data.tobytes(), {}
    for a, b, k in zip(first.tolist(), last.tolist(), bucket.tolist()):
        for w in range(a, b + 1):
            by.setdefault(text[w:w + length], set()).add(k)
    assert all(len(k) == 1 for k in by.values())


def test_a_frequent_line_is_one_context():
    """Crowds are of different contexts, not of documents that hold the same one."""
    contents = np.array([5, 5, 5, 7, 9, 9, 8, 9, 1], np.uint64)
    assert B._different(contents, np.array([3, 1, 4, 1])).tolist() == [1, 1, 2, 1]
