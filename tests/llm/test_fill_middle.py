"""Fill-in-the-middle against a plain version on whole strings."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idlespan.llm import fill_middle as M

SCHEMA = "doc_id long, text string, frames string, id int, form string, draws string"


def plain(ident, text):
    text, n = text or "", len(text or "")
    draws = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(draws[i:i + 8], 16) for i in range(0, 32, 8)]
    if not n or any(m in text for m in M.MARKS) or h[2] % 100 >= 90:
        return ident, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return ident, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return ident, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def make(rng):
    texts = [None, "", "a", "é", "🙂" * 7, "<P", "x<S>y", "<M>", "<" * 9, "P><S", "long ä🙂 " * 4000, "w" * 70_000]
    texts += ["".join(rng.choice("ab <PSM>é🙂\n") for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i * 3 - 20, t, "f", 1, "spm", None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id here", None, None, None, None)]


@pytest.mark.parametrize("units", [1, 5, M.FRAME_UNITS])
def test_outputs_and_digests(spark, units):
    rows = make(random.Random(units))
    if units < 100:
        rows = [r for r in rows if len(r[1] or "") < 1000]
    want = [plain(r[0], r[1]) for r in rows]
    out = M.transform(M.framed(spark.createDataFrame(rows, SCHEMA), units=units)).cache()
    read = {(r.id, r.text) for r in M.texts(out).collect()}
    assert read == {(None if w[0] is None else str(w[0]), w[5]) for w in want}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [tuple(r) for r in M.digests(out).collect()]
    expected = [(None if w[0] is None else str(w[0]), *w[1:5], sha(w[5]), sha(r[1] or "")) for r, w in zip(rows, want)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    out.unpersist()


def test_whole_frames_are_moved_and_only_cut_ones_opened(monkeypatch):
    text = "".join(map(chr, range(0x400, 0x400 + 1000)))
    source, opened = M.Frames.of(text, 100), []
    monkeypatch.setattr(M, "unpack", lambda f, real=M.unpack: opened.append(f) or real(f))
    out = M.rearrange(source, "psm", 250, 777)
    assert [f for f in source.frames if f not in out.frames] == opened == [source.frames[2], source.frames[7]]
    assert b"".join(out.stream()).decode() == f"<P>{text[:250]}<S>{text[777:]}<M>{text[250:777]}"
    assert out.n == 1009


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("a<>PSMé🙂")), min_size=1, max_size=30), st.integers(0, 30), st.integers(0, 30),
       st.integers(1, 7), st.sampled_from(["psm", "spm"]))
def test_every_text_without_marks_comes_back(text, first, second, units, form):
    if any(m in text for m in M.MARKS):
        return
    first, second = sorted((min(first, len(text)), min(second, len(text))))
    out = M.rearrange(M.Frames.of(text, units), form, first, second)
    assert b"".join(M.Restored(out, form).stream()).decode() == text


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.digests(M.transform(M.framed(none))).count() == 0
