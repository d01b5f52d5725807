"""License detections against a plain scan of whole texts."""

import random
import re

import pytest

from idlespan.llm import license_rules as L

SCHEMA = "doc_id long, text string, labels string, start int, _scan2 string, score int"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, ruleset):
    w = words_of(text)
    base, hits = [], []
    for phrase, label, _ in L.BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    keys = {r.key for r in ruleset}
    for i in [i for i, x in enumerate(w) if x in keys]:
        marked = " " + " ".join([*w[:i], L.MARK + w[i], *w[i + 1:]]) + " "
        for r in ruleset:
            m = re.search(r.pattern, marked) if r.key == w[i] else None
            if m:
                before, after = m[0].split(L.MARK)
                hits.append((i - before.count(" "), i + 1 + after.count(" "), r))

    def inside(h):                                            # equal intervals of one priority: the first name stays
        return any(g is not h and g[0] <= h[0] and g[1] >= h[1] and g[2].priority <= h[2].priority
                   and ((g[0], g[1], g[2].priority) != (h[0], h[1], h[2].priority) or g[2].name < h[2].name) for g in hits)
    kept = sorted({(h[0], h[1], h[2].label, h[2].name) for h in hits if not inside(h)})
    return len(w), sorted(base), kept


TEXTS = [
    None, "", "no such words", "MIT License", "the mit-license and the Apache License, Version 2.0.",
    "Licensed under the Apache License, Version 2.0", "This file is distributed under the terms of the GNU General Public License v3.0 or later",
    "gnu general public license gnu general public license version 2", "SPDX-License-Identifier: MIT license", "CC BY-SA 4.0 and cc by",
    "cc_by", "GNU Lesser General Public License version 2.1", "licence", "unlicense", "BSD 3-clause license", "Ä mit license ß",
    "all rights reserved copyright (c) 2019 2020 public domain in the public domain", "license " * 30, "cc by " * 40,
    "creative commons attribution share alike", "mitlicense mit  \n license", "gplv2 gpl v2 gpl 2",
]


@pytest.mark.parametrize("part", range(2))
def test_detections(spark, part):
    rng, ruleset = random.Random(part), L.rules()
    assert len(ruleset) > 300 and len({r.name for r in ruleset}) == len(ruleset)
    pool = sorted({x for t in TEXTS for x in words_of(t)})
    texts = TEXTS if part == 0 else [" ".join(rng.choice(pool) for _ in range(120)) for _ in range(30)]
    rows = [(i, t, None, 1, None, 2) for i, t in enumerate(texts)] + [(None, "mit license", None, None, None, None), (0, texts[0], None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(L.detect(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = {r[0]: brute(r[1], ruleset) for r in rows}
    for r in got:
        n, base, kept = want[r.doc_id]
        assert r["_scan"].n_words == n
        assert sorted((b.start, b.label) for b in r["_scan"].base) == base
        assert sorted((d.start, d.end, d.label, d.rule) for d in r["_scan"].detections) == kept
    for r in L.summarise(df).collect():
        n, base, kept = want[r.doc_id]
        assert (r.n_words, r.n_base, r.n_detections) == (n, len(base), len(kept))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b[1] for b in base}))
        assert r.labels == ",".join(sorted({b[1] for b in base} | {k[2] for k in kept}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(kept)


def test_no_rule_reaches_further_than_the_window():
    longest = max(len(re.sub(r"\(\?<= \)|\(\?= \)", "", r.pattern).split(" ")) for r in L.rules())
    assert longest <= L.REACH


def test_empty(spark):
    assert L.summarise(spark.createDataFrame([], SCHEMA)).count() == 0
