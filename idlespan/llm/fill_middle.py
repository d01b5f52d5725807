"""Fill-in-the-middle over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME_UNITS`` code points each, with the number of code points up to the
end of every frame.  A cut at any code point finds its frame in those counts, and only that frame is decompressed and cut in two;
frames that lie wholly in a part move to the output as they are.  The output is again such a list of frames, so that a digest, a
file or a text is one pass over frames in order, and no step holds more than the
two cut frames of a text decompressed.

The work is inside the row: no shuffle, no join.  The frames lie in Parquet below the shared folder, where later
steps and repeated tasks read them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved, whole_text

FRAME_UNITS = 1 << 14
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Order of the parts in the output of a form.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN = "plain"
BATCH_BYTES = 8 << 20
FRAMES = "frames array<binary>, ends array<long>"


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def pack(text: str) -> bytes:
    """One frame."""
    return _codec()[0].compress(text.encode("utf-8"))


def unpack(frame: bytes) -> bytes:
    return _codec()[1].decompress(frame)


_MARK_FRAMES = {mark: pack(mark) for mark in MARKS}


class Frames:
    """A text as independent frames; ``ends[i]`` counts the code points up to the end of frame i."""

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends = frames, ends
        self.open: dict[int, str] = {}

    @classmethod
    def of(cls, text: str, units: int = FRAME_UNITS) -> Frames:
        starts = range(0, len(text), units)
        return cls([pack(text[i:i + units]) for i in starts], [min(i + units, len(text)) for i in starts])

    @property
    def n(self) -> int:
        return self.ends[-1] if self.ends else 0

    def text(self, i: int) -> str:
        """The text of frame i.  The last two stay open: two cuts fall into two frames at most, and each is asked for twice."""
        if i not in self.open:
            if len(self.open) == 2:
                self.open.pop(next(iter(self.open)))
            self.open[i] = unpack(self.frames[i]).decode("utf-8")
        return self.open[i]

    def select(self, start: int, stop: int) -> Iterator[tuple[bytes, int]]:
        """Frames of the code points from ``start`` to ``stop``, with their lengths: cut ones anew, whole ones as stored."""
        i = bisect_right(self.ends, start)
        while start < stop:
            begin, end = self.ends[i - 1] if i else 0, self.ends[i]
            upto = min(stop, end)
            if start == begin and upto == end:
                yield self.frames[i], upto - start
            else:
                yield pack(self.text(i)[start - begin:upto - begin]), upto - start
            start, i = upto, i + 1

    def stream(self) -> Iterator[bytes]:
        """UTF-8 bytes, frame after frame."""
        return map(unpack, self.frames)


def rearrange(source: Frames, form: str, first: int, second: int) -> Frames:
    """The output of a form for a text whose prefix ends at ``first`` and whose middle ends at ``second``."""
    if form == PLAIN:
        return source
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, source.n)}
    frames, ends, at = [], [], 0
    for mark in FORMS[form]:
        for frame, n in [(_MARK_FRAMES[mark], len(mark)), *source.select(*spans[mark])]:
            at += n
            frames.append(frame)
            ends.append(at)
    return Frames(frames, ends)


class Restored:
    """Reads an output and its form back: digest of the output, and of the text that it was made from.

    One pass over the frames in order feeds the output's digest and finds the marks, which no part of a rearranged text
    contains; a mark may lie across frames.  Then prefix, middle and suffix are streamed, a frame at a time.
    """

    def __init__(self, output: Frames, form: str):
        digest, self.output, self.ends, self.at = hashlib.sha256(), output, [], []
        wanted = [m.encode() for m in FORMS.get(form, ())]
        at, tail = 0, b""
        for piece in output.stream():
            digest.update(piece)
            held, base, look = tail + piece, at - len(tail), 0
            while len(self.at) < len(wanted) and (found := held.find(wanted[len(self.at)], look)) >= 0:
                look = found + len(wanted[0])
                self.at.append(base + found)
            at += len(piece)
            tail = held[max(look, len(held) - len(PREFIX) + 1):]
            self.ends.append(at)
        self.output_sha256 = digest.hexdigest()
        if len(self.at) < len(wanted):
            raise ValueError(f"not an output of form {form}")
        stops = dict(zip(FORMS.get(form, ()), zip(self.at, [*self.at[1:], at])))
        self.spans = [(stops[m][0] + len(m), stops[m][1]) for m in (PREFIX, MIDDLE, SUFFIX)] if stops else [(0, at)]

    def stream(self) -> Iterator[bytes]:
        """Bytes of the text in its own order."""
        for start, stop in self.spans:
            i = bisect_right(self.ends, start)
            while start < stop:
                begin = self.ends[i - 1] if i else 0
                upto = min(stop, self.ends[i])
                yield unpack(self.output.frames[i])[start - begin:upto - begin]
                start, i = upto, i + 1

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.stream():
            digest.update(piece)
        return digest.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch], row, schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """``row`` of every input row; an output batch holds about ``BATCH_BYTES``."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            held.append(row(*[c[i].as_py() for c in columns]))
            size += weigh(held[-1])
            if size >= BATCH_BYTES or len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_LISTS = [("frames", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64()))]


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = FRAME_UNITS) -> DataFrame:
    """Every text in frames: ``id``, ``marked`` (one of the marks stands in the text), ``frames``, ``ends``; written once.

    A null text is empty and has no frame.  Rows that repeat an id stay rows of their own, null ids stay null, other columns are
    ignored, an empty table gives an empty one.  A very long text costs its own size and one frame, since a row holds it anyway.
    """
    schema = pa.schema([("id", pa.string()), ("marked", pa.bool_()), *_LISTS])

    def row(ident: str | None, text: str):
        kept = Frames.of(text, units)
        return ident, any(m in text for m in MARKS), kept.frames, kept.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, row, schema, lambda r: 64 + sum(map(len, r[2])))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole_text(text_col).alias("text"))
    return saved(rows.mapInArrow(run, f"id string, marked boolean, {FRAMES}"), "text-frames", "uncompressed")


def transform(stored: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """The outputs of framed texts: ``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``frames``, ``ends``.

    Draws are the first four 32-bit groups of sha256("seed:id") (a null id counts as no digits): two cuts modulo n + 1, then
    ``rate`` per cent of the texts are rearranged, ``spm`` per cent of those suffix first.  Texts that are empty or contain a mark stay plain,
    with null lengths.  Equal cuts give an empty middle, a cut at 0 or n an empty prefix or suffix.
    """
    schema = pa.schema([("id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), *_LISTS])

    def row(ident: str | None, marked: bool, frames: list[bytes], ends: list[int], draws: str):
        source = Frames(frames, ends)
        one, two, three, four = (int(draws[i:i + 8], 16) for i in range(0, 32, 8))
        if not source.n or marked or three % 100 >= rate:
            return ident, source.n, PLAIN, None, None, frames, ends
        first, second = sorted((one % (source.n + 1), two % (source.n + 1)))
        form = "spm" if four % 100 < spm else "psm"
        out = rearrange(source, form, first, second)
        return ident, source.n, form, first, second - first, out.frames, out.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, row, schema, lambda r: 64 + sum(map(len, r[5])))
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256)
    return stored.select("id", "marked", "frames", "ends", draws.alias("draws")).mapInArrow(
        run, f"id string, n long, form string, prefix_chars long, middle_chars long, {FRAMES}")


def digests(outputs: DataFrame) -> DataFrame:
    """``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output_sha256``, ``restored_sha256`` of outputs; the text is rebuilt
    from output and form alone."""
    kept = [("id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema([*kept, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def row(ident, n, form, prefix, middle, frames, ends):
        read = Restored(Frames(frames, ends), form)
        return ident, n, form, prefix, middle, read.output_sha256, read.sha256()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, row, schema, lambda r: 256)
    return outputs.select(*[c for c, _ in kept], "frames", "ends").mapInArrow(
        run, "id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def texts(outputs: DataFrame) -> DataFrame:
    """``id`` and the whole ``text`` of stored or rearranged frames."""
    schema = pa.schema([("id", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, lambda i, f, e: (i, b"".join(Frames(f, e).stream()).decode("utf-8")), schema, lambda r: 64 + len(r[1]))
    return outputs.select("id", "frames", "ends").mapInArrow(run, "id string, text string")
