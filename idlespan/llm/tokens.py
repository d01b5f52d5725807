"""Token ids of whole texts with a public tokenizer, inside Spark tasks."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
#: The characters with the Unicode property White_Space, which the tokenizers' patterns call \\s.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Latin letters, and marks behind which neither vocabulary's pattern looks back.
LETTERS, STOPS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?|"
#: A run of Latin letters that such a mark or the end of a word follows is a token group of its own in both vocabularies.
RUN = f"[{LETTERS}]+(?=[{STOPS}{WHITE_SPACE}]|\\Z)"
#: A text cut where no token of the byte-level pattern can reach across: a word takes one space before it.
WITH_SPACE = re.compile(f" ?{RUN}| ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
#: For tokenizers that drop white space.
WITHOUT_SPACE = re.compile(f"{RUN}|[^{WHITE_SPACE}]+")
PLAIN = re.compile(f"[{LETTERS}]+").fullmatch
MEMORY_WORDS = 800_000
LONGEST_REMEMBERED = 40
TOGETHER = 64


class Encoder:
    """Encodes texts with the tokenizers library, each different word of a batch once.

    Tokens never reach across white space in either vocabulary, nor from a run of letters to a comma or stop behind it, so the ids of a text are
    the ids of its pieces one after the other (tests compare with encoding whole texts).  The first ``memory`` different pieces a
    worker meets keep their ids; they hold the frequent ones, and the memory is bounded.  The strings of special tokens in a
    text are ordinary text.
    """

    def __init__(self, path: str, keeps_space: bool, memory: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"                     # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = (WITH_SPACE if keeps_space else WITHOUT_SPACE).findall
        self.known: dict[str, bytes] = {}
        self.memory = memory
        self.keeps_space = keeps_space
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)    # byte-level: a character of a token is a byte of text
        self.ends = np.zeros(len(self.n_bytes), bool)                      # words: a token that ends one
        for token, i in vocabulary.items():
            self.n_bytes[i], self.ends[i] = len(token), token.endswith("</w>")

    def _side_by_side(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that can stand side by side, ``TOGETHER`` at a time; the ids are cut where a word ends."""
        between = "" if self.keeps_space else " "
        lines = [between.join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        if self.keeps_space:
            ends = np.cumsum([len(w.encode("utf-8")) for w in words])
            last = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends)
        else:
            last = np.flatnonzero(self.ends[ids])
        cut, data = (4 * (last + 1)).tolist(), ids.tobytes()
        return dict(zip(words, map(data.__getitem__, map(slice, [0, *cut[:-1]], cut))))

    def _ids_of(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different pieces."""
        if self.keeps_space:
            together = [w for w in words if w[0] == " " and len(w) > 1 and w[1] != " "]
            found = self._side_by_side(together) if together else {}
        else:                                                              # this vocabulary lower-cases: each word once
            lower = {w: w.lower() for w in words if PLAIN(w)}
            together = self._side_by_side(list(dict.fromkeys(lower.values()))) if lower else {}
            found = {w: together[v] for w, v in lower.items()}
        rest = [w for w in words if w not in found]
        found.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in
                                self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text (null: empty) with the end id behind them, as unsigned 32-bit integers.  Equal texts are encoded once."""
        known, end = self.known, np.array([END_ID], "<u4").tobytes()
        cut = {t: self.pieces(t) if t else [] for t in dict.fromkeys(texts)}
        fresh = list(set(chain.from_iterable(cut.values())).difference(known))
        known.update(self._ids_of(fresh))
        made = {t: np.frombuffer(b"".join([*map(known.__getitem__, words), end]), "<u4") for t, words in cut.items()}
        for w in fresh:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        while len(known) > self.memory:
            known.popitem()                                                # the newest first
        return [made[t] for t in texts]


@lru_cache(maxsize=2)
def shared_encoder(path: str, keeps_space: bool, memory: int = MEMORY_WORDS) -> Encoder:
    """The encoder of this worker: its tasks share one tokenizer and one memory of words."""
    return Encoder(path, keeps_space, memory)


def slices_of(batch: pa.RecordBatch, text_col: str, size: int = 1 << 20):
    """Runs of rows of ``batch`` with about ``size`` bytes of text each, so that few texts at a time are Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, before + size)) + 1, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def batches_of(texts: list[str | None], chars: int = 3 << 20):
    """Ranges of ``texts`` with about ``chars`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
