"""Encoding by words, token files and packing against the plain ways."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idlespan.llm import elias_fano, vector_fit
from idlespan.llm.tokens import Encoder, slices_of

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, piece string, start int, sequence_id string, block string"
KINDS = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
CHARS = st.one_of(st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​'sSt're,.!?*|<>0129aAbBéÉßΣİ́漢字🙂")), st.characters(codec="utf-8"))


def plain(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("name", KINDS)
def test_words_give_the_ids_of_whole_texts(name):
    whole, words = plain(name), Encoder(P.path(name), KINDS[name], memory=50)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(CHARS, max_size=40), max_size=4))
    def same(texts):
        texts = [*texts, None, "<|endoftext|> a <|startoftext|>b", "it's  they're \n\n x"]
        assert [x.tolist() for x in words.encode(texts)] == [whole(t) for t in texts]
    same()


def test_elias_fano():
    rng = random.Random(1)
    for values in ([], [0], [0, 0, 0], [5] * 200, [2**64 - 1], [0, 2**63], sorted(rng.randrange(10**6) for _ in range(3000)),
                   sorted(rng.randrange(50) for _ in range(500)), list(range(1000))):
        packed, rest = elias_fano.EliasFano.from_bytes(memoryview(elias_fano.EliasFano.of(np.array(values, np.uint64)).to_bytes() + b"x"))
        assert packed.values().tolist() == values and bytes(rest) == b"x"
        assert [packed[i] for i in range(len(values))] == values
    many = elias_fano.EliasFano.of(np.arange(0, 4_000_000, 400, dtype=np.uint64))
    assert 8 * len(many.to_bytes()) < 12 * 10_000                                   # bits per boundary, select samples included


def rows_of(rng):
    texts = [None, "", " ", "a", "hello world " * 30, "x y z\n" * 3000, "w" * 100_000, *["some words here " * rng.randrange(300) for _ in range(40)]]
    rows = [(i * 7, t, "c", 1, None, None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, "nameless", None, None, None, None)]


def test_files_round_trip(spark):
    rows = rows_of(random.Random(2))
    path, whole = P.path("byte_bpe_50k.json"), plain("byte_bpe_50k.json")
    parts = elias_fano.write_parts(spark.createDataFrame(rows, SCHEMA), path, 2, True, part_ids=500)
    assert parts.count() > 5
    got = sorted(elias_fano.read_documents(parts, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), whole(t)) for d, t, *_ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    part = elias_fano.Part(parts.orderBy("section", "part").first().payload)
    assert [part.document(i).tolist() for i in range(part.n)] == [r.ids for r in got[:part.n]]


@pytest.mark.parametrize("limits", [{}, {"documents": 3, "attention": 20_000}, {"score": "dot"}])
def test_packing(spark, limits):
    rows = rows_of(random.Random(3))
    whole = plain("word_bpe_49k.json")
    got = vector_fit.pack_documents(spark.createDataFrame(rows, SCHEMA), P.path("word_bpe_49k.json"), False, 256, block=64, **limits).collect()
    want = [(d, at // 256, at, len(ids[at:at + 256]), zlib.crc32(np.array(ids[at:at + 256], "<u4").tobytes()))
            for d, ids in ((r[0], whole(r[1])) for r in rows) for at in range(0, len(ids), 256)]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256
        assert len(s) <= limits.get("documents", 1024)
        assert len(s) == 1 or sum(n * n for _, n in s) <= limits.get("attention", 256 * 256)


def test_fill():
    rng = np.random.default_rng(4)
    lengths = -np.sort(-rng.integers(1, 2049, 8192))
    at, _ = vector_fit.best_fit(lengths, 2048, 1024, 2048 * 2048, vector_fit.WEIGHTS)
    assert at.max() + 1 <= 1.02 * lengths.sum() / 2048


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert elias_fano.read_documents(elias_fano.write_parts(none, P.path("byte_bpe_50k.json"), 2, True)).count() == 0
    assert vector_fit.pack_documents(none, P.path("word_bpe_49k.json"), False).count() == 0


def test_slices_hold_every_row_once_and_in_order():
    rng = random.Random(6)
    texts = [rng.choice([None, "", "é" * rng.randrange(30), "z" * 500]) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    for part, want in ((batch, texts), (batch.slice(37, 200), texts[37:237]), (batch.slice(0, 0), [])):
        some = list(slices_of(part, "text", 100))
        assert [t for s in some for t in s.column("text").to_pylist()] == want
        assert [i for s in some for i in s.column("id").to_pylist()] == part.column("id").to_pylist()
        assert all(sum(len((t or "").encode()) for t in s.column("text").to_pylist()[:-1]) < 100 for s in some)


def test_memory_of_packing_does_not_follow_the_words():
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(600)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["id", "text"])
    del texts
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in vector_fit._cut(P.path("word_bpe_49k.json"), False, 2048, 200_000)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 3000 and peak < 100e6
