"""Repeated substrings across documents by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  Sorting all suffixes would
shuffle every position, so buckets are begun only at anchors: of the q-grams of a window the one with the smallest hash, which equal windows
place alike.  Windows in a row with one anchor that have it in the same part of them (first quarter, middle, last quarter) are a context.
All of them hold the anchor and a known number of bytes on either side of it, and these bytes are the context's bucket: a q-gram alone
is in most documents of a large table, the 34 to 42 bytes around it (of 50) hardly in two that do not share a window.

1. Every chunk of documents sends the buckets of its contexts; a bucket of one document is finished.
2. The chunk sends the other contexts, each different one once with its smallest document.
3. In each shard of buckets the contexts are refined: 8-byte buckets, then 16 bytes by sorting pairs (bucket, bucket 8 bytes later),
   then 32 and ``length`` in the same way from the buckets just made.  Positions alone in a bucket drop out of every later round.
   The smallest document of each final bucket goes back to the chunks.
4. The chunk marks the bytes.

Texts are shuffled once, compressed and by chunk, and all four steps use that one exchange.  Exact copies of a smaller document are settled before
by their digest.  A frequent passage costs one context per chunk, however many documents hold it.

A bucket with over ``CROWD`` different contexts is not gathered: windows across the edge of a frequent passage, or around a phrase shorter than
``length``, share the bucket's bytes but have each document's own beside them.  Its windows go out one by one instead, each different one
of a chunk once, to the shard that a hash of all their bytes gives; equal windows meet there, and their bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import parts_for, saved, whole_text

LENGTH = 50
Q = 16
CHUNK_BYTES = 8 << 20
SEGMENT = 1 << 20
PLACE_BITS = 24
NO_ID = 2**63 - 1
CROWD = 1 << 14
DUPLICATE, BUCKETS, ANSWERS, CROWDED, WINDOWS = 0, 1, 2, 3, 4
NOTE = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
MAIL = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])


# ---- anchors ------------------------------------------------------------------------------------------------------------

def anchors(data: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the windows that start at ``first`` (ascending): anchor place, first window, last window, hash of the bucket's bytes, and
    a sum over the q-grams of the whole context."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,)).copy()      # the eight bytes from every place on
    n = len(data) - Q + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += eight[8:8 + n]
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(n, dtype=np.uint64)                            # ties go to the first place
    width, span = length - Q + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    place = (least[first] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    place, first, last = place[new], first[new], first[np.r_[new[1:], len(first)] - 1]
    reach = length - Q
    quarter = reach // 4 + 1
    far = reach - quarter + 1
    left, right = np.array([far, quarter, 0]), np.array([0, quarter, far])        # bytes that windows of each kind hold beside the anchor
    first = np.maximum(first[:, None], place[:, None] - (reach - right)).ravel()
    last = np.minimum(last[:, None], place[:, None] - left).ravel()
    some = np.flatnonzero(first <= last)
    place, first, last = place[some // 3], first[some], last[some]
    begin, end = place - left[some % 3], place + right[some % 3]                  # the bucket's bytes begin and end with these q-grams
    bucket = h[begin]
    for step in [*range(Q, max(far, 2 * quarter), Q), reach]:
        bucket ^= bucket >> np.uint64(32)
        bucket *= np.uint64(0xFF51AFD7ED558CCD)
        bucket += h[np.minimum(begin + step, end)]
    bucket ^= bucket >> np.uint64(29)
    bucket *= np.uint64(0xC4CEB9FE1A85EC53)
    bucket ^= bucket >> np.uint64(32)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    return place, first, last, bucket, total[last + reach + 1] - total[first]


class Chunk:
    """The documents of a chunk, in order of id, without exact copies of smaller ones."""

    def __init__(self, docs: pa.Table, notes: pa.Table, length: int, shards: int = 1):
        self.length, self.shards = length, shards
        rows = sorted(zip(docs.column("id").to_pylist(), docs.column("data").to_pylist()))
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        kinds, blobs = notes.column("kind").to_pylist(), notes.column("data").to_pylist()
        self.copies = set()
        for kind, blob in zip(kinds, blobs):
            if kind == DUPLICATE:
                self.copies.update(map(tuple, np.frombuffer(blob, ">i8").reshape(-1, 2).tolist()))
        self.answers = [b for k, b in zip(kinds, blobs) if k == ANSWERS]
        self.window_answers = [b for k, b in zip(kinds, blobs) if k == WINDOWS]

        def told(*which: int) -> np.ndarray:
            found = [_bucket(np.frombuffer(b, "<u4", 1), np.frombuffer(b, "<u4", -1, 4)) for k, b in zip(kinds, blobs) if k in which]
            return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.buckets, self.crowded = told(BUCKETS, CROWDED), told(CROWDED)
        self.maybe = np.zeros(1 << 22, bool)                                       # by the low bits of a bucket, whether it can be one of them
        self.maybe[self.buckets & np.uint64(len(self.maybe) - 1)] = True

    def is_copy(self, i: int) -> bool:
        return bool(self.copies) and (self.ids[i], _signed(self.texts[i])) in self.copies

    def contexts(self, all_buckets: bool = False) -> Iterator[tuple]:
        """Per segment of about ``SEGMENT`` bytes: data, document of each context, shift, its place, first and last window, bucket."""
        return (found[:-1] for found in self.segments(all_buckets))

    def segments(self, all_buckets: bool) -> Iterator[tuple]:
        """What ``contexts`` gives, and a hash of each context.

        Long documents are cut into segments that overlap by a window, so each window belongs to one segment.
        """
        held, firsts, docs, begins, size = [], [], [], [], 0
        for i, text in enumerate(self.texts):
            if len(text) < self.length or self.is_copy(i):
                continue
            for begin in range(0, len(text) - self.length + 1, SEGMENT):
                piece = text[begin:begin + SEGMENT + self.length - 1]
                held.append(piece)
                firsts.append(np.arange(size, size + len(piece) - self.length + 1))
                docs.append(i)
                begins.append(begin)
                size += len(piece)
                if size >= SEGMENT:
                    yield self._segment(held, firsts, docs, begins, all_buckets)
                    held, firsts, docs, begins, size = [], [], [], [], 0
        if held:
            yield self._segment(held, firsts, docs, begins, all_buckets)

    def _segment(self, held: list[bytes], firsts: list[np.ndarray], docs: list[int], begins: list[int], all_buckets: bool) -> tuple:
        data = b"".join(held)
        place, first, last, bucket, content = anchors(np.frombuffer(data, np.uint8), np.concatenate(firsts), self.length)
        bucket = _bucket((bucket >> np.uint64(32)) % np.uint64(self.shards), bucket & np.uint64(0xFFFFFFFF))
        if not all_buckets:
            some = np.flatnonzero(self.maybe[bucket & np.uint64(len(self.maybe) - 1)])
            some = some[np.isin(bucket[some], self.buckets)]
            place, first, last, bucket, content = (x[some] for x in (place, first, last, bucket, content))
        starts = np.array([f[0] for f in firsts])
        piece = np.searchsorted(starts, first, "right") - 1
        doc, shift = np.array(docs)[piece], (np.array(begins) - starts)[piece]     # place in the document = place here + shift
        return data, doc, shift, place, first, last, bucket, content


def _signed(text: bytes) -> int:
    value = xxhash.xxh64_intdigest(text, 42)
    return value - 2**64 if value >= 2**63 else value


def _bucket(shard: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A bucket is a shard and 32 bits: shards grow with the table, so what one holds does not fill them, and they travel in four bytes."""
    return shard.astype(np.uint64) << np.uint64(32) | hashed.astype(np.uint64)


def _shard(bucket: np.ndarray) -> np.ndarray:
    return (bucket >> np.uint64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of what goes to each shard."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(shard[part[0]]), part


def _by_chunk(chunk: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``chosen`` indices by their chunk."""
    ordered = chosen[np.argsort(chunk[chosen], kind="stable")]
    for part in np.split(ordered, np.flatnonzero(np.diff(chunk[ordered])) + 1):
        if len(part):
            yield int(chunk[part[0]]), part


def _told(number: np.ndarray, edge: np.ndarray, ids: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Answers: numbers of contexts, windows from which on, smallest documents."""
    return pack.compress(number.astype("<u4").tobytes() + edge.astype("<u2").tobytes() + ids.astype("<i8").tobytes())


def _answers(blobs: list[bytes]) -> np.ndarray:
    """Three rows of all ``_told``."""
    open_, out = zstandard.ZstdDecompressor(), [np.zeros((3, 0), np.int64)]
    for blob in blobs:
        body = open_.decompress(blob)
        n = len(body) // 14
        parts = [("<u4", 0), ("<u2", 4 * n), ("<i8", 6 * n)]
        out.append(np.stack([np.frombuffer(body, kind, n, at).astype(np.int64) for kind, at in parts]))
    return np.concatenate(out, axis=1)


def _mail(rows: list[tuple[int, int, bytes]], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# ---- texts on their way to the chunks ----------------------------------------------------------------------------------

def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed by itself."""
    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        data = pa.array([pack.compress(text.as_buffer()) for text in batch.column("data")], pa.binary())
        yield pa.record_batch([batch.column("chunk"), batch.column("id"), data], names=["chunk", "id", "data"])


def _opened(run):
    """``run`` for the documents of a chunk as ``_packed`` left them."""
    def opened(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        data = pa.array([open_.decompress(text.as_buffer()) for text in docs.column("data")], pa.binary())
        return run(key, docs.set_column(docs.column_names.index("data"), "data", data), notes)
    return opened


# ---- the four steps -----------------------------------------------------------------------------------------------------

def _different(content: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many different values there are in each run of ``size`` values."""
    out = np.ones(len(size), np.int64)
    some = np.flatnonzero(np.repeat(size > 1, size))
    if len(some):
        run, value = np.repeat(np.arange(len(size)), size)[some], content[some]
        order = np.lexsort((value, run))
        run, value = run[order], value[order]
        new = np.r_[True, (run[1:] != run[:-1]) | (value[1:] != value[:-1])]
        out = np.maximum(out, np.bincount(run[new], minlength=len(size)))
    return out


def _send_buckets(length: int, shards: int):
    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes, length, shards)
        found = [(bucket, doc, content) for _, doc, _, _, _, _, bucket, content in chunk.segments(True)]
        if not found:
            return MAIL.empty_table()
        bucket, doc, content = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(bucket, kind="stable")                                  # documents ascend within a bucket
        bucket, doc, content = bucket[order], doc[order], content[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(bucket)])
        several, times = doc[start] != doc[start + size - 1], _different(content, size).astype("<u4")
        bucket = bucket[start]
        return _mail([(s, key[0].as_py(), several[i].tobytes() + times[i].tobytes() + bucket[i].astype("<u4").tobytes())
                      for s, i in _by_shard(_shard(bucket))], MAIL)
    return run


def _shared_buckets(crowd: int):
    def run(key: tuple, mail: pa.Table) -> pa.Table:
        """The buckets of a shard that more than one document has, told to every chunk that has them."""
        chunk, several, times, bucket = [], [], [], []
        for c, blob in zip(mail.column("chunk").to_pylist(), mail.column("data").to_pylist()):
            n = len(blob) // 9
            several.append(np.frombuffer(blob, bool, n))
            times.append(np.frombuffer(blob, "<u4", n, n).astype(np.int64))
            bucket.append(np.frombuffer(blob, "<u4", n, 5 * n))
            chunk.append(np.full(n, c, np.int32))
        chunk, several, times, bucket = (np.concatenate(x) for x in (chunk, several, times, bucket))
        order = np.argsort(bucket, kind="stable")
        start = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
        size = np.diff(np.r_[start, len(order)])
        shared = np.repeat((size > 1) | np.logical_or.reduceat(several[order], start), size)
        crowded = np.repeat(np.add.reduceat(times[order], start) > crowd, size)
        shard = mail.column("shard")[0].as_py().to_bytes(4, "little")
        rows = [(c, kind, shard + bucket[part].tobytes()) for kind, some in ((BUCKETS, shared & ~crowded), (CROWDED, shared & crowded))
                for c, part in _by_chunk(chunk, order[some])]
        return _mail(rows, NOTE)
    return run


def _numbered(chunk: Chunk) -> tuple[dict[tuple[int, bytes], int], list[int], Iterator]:
    """Different contexts of a chunk as they are met: (anchor's offset, bytes) to number; the smallest document of each."""
    number: dict[tuple[int, bytes], int] = {}
    smallest: list[int] = []

    def walk():
        for data, doc, shift, place, first, last, bucket in chunk.contexts():
            names = []
            for d, p, a, b in zip(doc.tolist(), place.tolist(), first.tolist(), last.tolist()):
                context = (p - a, data[a:b + chunk.length])
                k = number.get(context)
                if k is None:
                    k = number[context] = len(smallest)
                    smallest.append(d)
                names.append(k)
            yield doc, shift, first, last, bucket, np.array(names, np.int64)
    return number, smallest, walk()


def _windows(chunk: Chunk, contexts: list[tuple[int, bytes]], smallest: list[int], crowded: list[int]) -> tuple[dict[bytes, int], list[int]]:
    """Different windows of the contexts numbered in ``crowded``: bytes to number; the smallest document of each."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    for k in crowded:
        text = contexts[k][1]
        for w in range(len(text) - chunk.length + 1):
            n = number.setdefault(text[w:w + chunk.length], len(least))
            if n == len(least):
                least.append(smallest[k])
            elif smallest[k] < least[n]:
                least[n] = smallest[k]
    return number, least


def _send_contexts(length: int, shards: int):
    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes, length, shards)
        number, smallest, walk = _numbered(chunk)
        bucket = np.zeros(0, np.uint64)
        for _, _, _, _, own, names in walk:
            if len(smallest) > len(bucket):
                bucket = np.concatenate([bucket, np.zeros(len(smallest) - len(bucket), np.uint64)])
            bucket[names] = own
        pack, rows, contexts = zstandard.ZstdCompressor(3), [], list(number)

        def send(kind: int, texts: list[bytes], docs_: list[int], dealt: np.ndarray, chosen: np.ndarray) -> None:
            ids = np.array([chunk.ids[d] for d in docs_], np.int64)
            sizes = np.fromiter(map(len, texts), np.uint16, len(texts))
            for shard, part in _by_shard(dealt[chosen]):
                i = chosen[part]
                body = i.astype("<u4").tobytes() + ids[i].astype("<i8").tobytes() + sizes[i].tobytes() + b"".join([texts[k] for k in i.tolist()])
                rows.append((shard, key[0].as_py(), bytes([kind]) + len(i).to_bytes(4, "little") + pack.compress(body)))
        crowded = np.isin(bucket, chunk.crowded)
        send(ANSWERS, [c[1] for c in contexts], smallest, _shard(bucket), np.flatnonzero(~crowded))
        if crowded.any():
            windows, least = _windows(chunk, contexts, smallest, np.flatnonzero(crowded).tolist())
            dealt = np.fromiter((xxhash.xxh64_intdigest(w, 42) % shards for w in windows), np.int64, len(windows))
            send(WINDOWS, list(windows), least, dealt, np.arange(len(windows)))
        return _mail(rows, MAIL)
    return run


def refined(pool: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the ``length`` bytes from every place of ``pool`` on, -1 where they are alone or exceed ``room``.

    Buckets of 8 bytes are refined by the buckets of later offsets; each round reuses the ids of the one before.
    """
    padded = np.concatenate([pool, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(pool),), "<u8", padded, strides=(1,))
    bucket = np.full(len(pool), -1, np.int32)

    def place(at: np.ndarray, value: np.ndarray) -> None:
        bucket[:] = -1
        if len(at):
            order = np.argsort(value)
            value = value[order]
            new = np.r_[True, value[1:] != value[:-1]]
            many = ~(new & np.r_[new[1:], True])
            bucket[at[order[many]]] = np.cumsum(new, dtype=np.int32)[many]
    at = np.flatnonzero(room >= 8).astype(np.int32)
    place(at, eight[at])
    have = 8
    while have < length:
        grown = min(2 * have, length)
        at = np.flatnonzero((room >= grown) & (bucket >= 0)).astype(np.int32)
        at = at[bucket[at + grown - have] >= 0]
        place(at, bucket[at] * np.int64(len(pool)) + bucket[at + grown - have])
        have = grown
    return bucket


def _refine(length: int):
    def run(key: tuple, mail: pa.Table) -> pa.Table:
        pack, open_ = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        chunk, number, ids, sizes, texts, kinds, sizes_of = mail.column("chunk").to_pylist(), [], [], [], [], [], []
        for blob in mail.column("data").to_pylist():
            n, body = int.from_bytes(blob[1:5], "little"), open_.decompress(blob[5:])
            kinds.append(blob[0])
            sizes_of.append(n)
            number.append(np.frombuffer(body, "<u4", n))
            ids.append(np.frombuffer(body, "<i8", n, 4 * n))
            sizes.append(np.frombuffer(body, "<u2", n, 12 * n).astype(np.int64))
            edge = (14 * n + np.r_[0, np.cumsum(sizes[-1])]).tolist()
            texts += [body[a:b] for a, b in zip(edge, edge[1:])]
        number, ids = np.concatenate(number), np.concatenate(ids)
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(t, len(seen)) for t in texts), np.int64, len(texts))   # equal contexts are one
        least = np.full(len(seen), NO_ID, np.int64)
        np.minimum.at(least, which, ids)
        size = np.fromiter(map(len, seen), np.int64, len(seen))
        pool = np.frombuffer(b"".join(seen), np.uint8)
        begin = np.r_[0, np.cumsum(size)[:-1]]
        room = (np.repeat((begin + size).astype(np.int32), size) - np.arange(len(pool), dtype=np.int32)).astype(np.uint16)
        bucket = refined(pool, room, length)
        smallest = np.repeat(least, size)                                           # of the window at each place
        shared = np.flatnonzero(bucket >= 0)
        low = np.full(int(bucket.max()) + 1 if len(shared) else 0, NO_ID, np.int64)
        np.minimum.at(low, bucket[shared], smallest[shared])
        smallest[shared] = low[bucket[shared]]
        windows = size - length + 1
        lowest = np.minimum.reduceat(np.where(room < length, NO_ID, smallest), begin)
        asks = np.flatnonzero(lowest[which] < ids)
        count = windows[which[asks]]
        of = np.repeat(asks, count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        mins = smallest[begin[which[of]] + step]
        edge = np.flatnonzero((step == 0) | np.r_[True, mins[1:] != mins[:-1]])     # runs of windows with one smallest document
        of, step, mins = of[edge], step[edge], mins[edge]
        ends = np.searchsorted(of, np.cumsum(sizes_of))
        rows = [(c, kind, _told(number[of[a:b]], step[a:b], mins[a:b], pack))
                for c, kind, a, b in zip(chunk, kinds, np.r_[0, ends[:-1]].tolist(), ends.tolist()) if a < b]
        return _mail(rows, NOTE)
    return run


RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _window_answers(chunk: Chunk, number: dict[tuple[int, bytes], int], smallest: list[int], crowded: list[int]) -> np.ndarray:
    """Answers like those of ``_refine`` for contexts whose windows were sent one by one."""
    contexts = list(number)
    windows, least = _windows(chunk, contexts, smallest, crowded)
    low = np.array([chunk.ids[d] for d in least], np.int64)
    which, _, ids = _answers(chunk.window_answers)
    np.minimum.at(low, which, ids)
    out = []
    for k in crowded:
        text = contexts[k][1]
        mins = low[[windows[text[w:w + chunk.length]] for w in range(len(text) - chunk.length + 1)]]
        edge = np.flatnonzero(np.r_[True, mins[1:] != mins[:-1]])
        out.append(np.stack([np.full(len(edge), k), edge, mins[edge]]))
    return np.concatenate(out, axis=1)


def _mark(length: int, shards: int, texts: bool):
    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes, length, shards)
        number, smallest, walk = _numbered(chunk)
        walk = list(walk)
        told = _answers(chunk.answers)
        crowded = [names[np.isin(own, chunk.crowded)] for _, _, _, _, own, names in walk] if len(chunk.crowded) else []
        crowded = np.unique(np.concatenate(crowded)).tolist() if crowded else []
        if crowded:
            told = np.concatenate([told, _window_answers(chunk, number, smallest, crowded)], axis=1)
        told = told[:, np.lexsort((told[1], told[0]))]
        ids = np.array(chunk.ids, np.int64)
        removed = [np.zeros((3, 0), np.int64)]
        for doc, shift, first, last, _, names in walk:
            if not len(names):
                continue
            # pieces of windows with one smallest document: the answers, or the context's first document in this chunk
            lo, hi = np.searchsorted(told[0], names, "left"), np.searchsorted(told[0], names, "right")
            count = np.maximum(hi - lo, 1)
            of = np.repeat(np.arange(len(names)), count)
            step = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            at = np.minimum(lo[of] + step, max(0, told.shape[1] - 1))
            has = (hi > lo)[of]
            own = ids[np.array(smallest)[names]][of]
            edge = np.where(has, told[1][at], 0) if told.shape[1] else np.zeros(len(of), np.int64)
            low = np.where(has, told[2][at], own) if told.shape[1] else own
            start = first[of] + edge
            stop = np.r_[start[1:] - 1, 0]
            ends = np.r_[of[1:] != of[:-1], True]
            stop[ends] = last[of[ends]]
            gone = low < ids[doc[of]]
            removed.append(np.stack([doc[of], start + shift[of], stop + shift[of] + length])[:, gone])
        removed = np.concatenate(removed, axis=1)
        doc, start, stop = removed[:, np.lexsort((removed[1], removed[0]))]         # pieces that begin later end later
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])][:len(doc)])
        doc, start, stop = doc[new], start[new], stop[np.r_[new[1:], len(stop)][:len(new)] - 1]
        of_doc = np.searchsorted(doc, np.arange(len(chunk.ids) + 1)).tolist()
        start, stop = start.tolist(), stop.tolist()
        out = []
        for i, text in enumerate(chunk.texts):
            if chunk.is_copy(i):
                spans = [(0, len(text))] if len(text) >= length else []
            else:
                spans = list(zip(start[of_doc[i]:of_doc[i + 1]], stop[of_doc[i]:of_doc[i + 1]]))
            edges = [0, *[x for s in spans for x in s], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append({"id": None if chunk.ids[i] == NO_ID else chunk.ids[i], "n_bytes": len(text),
                        "spans": [{"start": a, "end": b} for a, b in spans],
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if texts else None})
        return pa.Table.from_pylist(out, schema=RESULT)
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False,
                   chunk_bytes: int = CHUNK_BYTES, crowd: int = CROWD) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``spans`` (maximal removed runs, start and end), ``kept_sha256``, and ``kept`` (the bytes that
    stay) if ``texts``.

    Texts are UTF-8 bytes, null is empty; windows never cross documents and are judged on the input.  Texts shorter than ``length`` (at least
    32) lose nothing.  A null id is larger than any other; rows with one id never remove from each other.  Other columns
    are ignored; an empty table gives none.  Buckets of step 1 are hashes, and everything after compares the bytes.
    """
    data = whole_text(text_col).cast("binary")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    chunks = parts_for(docs.agg(F.sum(F.octet_length(data))).first()[0], chunk_bytes, 12)

    def chunk_of(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(chunks)).cast("int")
    marks = docs.select(ident.alias("id"), F.sha2(data, 256).alias("digest"), F.xxhash64(whole_text(text_col)).alias("mark"))
    firsts = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = marks.join(firsts, "digest").filter("id > first").select(
        chunk_of(F.col("id")).alias("chunk"), F.lit(DUPLICATE).alias("kind"),
        F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("id", "mark")])).alias("data"))
    copies = saved(copies, "exact-copies").repartition(chunks, "chunk")
    rows = docs.select(chunk_of(ident).alias("chunk"), ident.alias("id"), data.alias("data"))
    rows = rows.mapInArrow(_packed, "chunk int, id long, data binary").repartition(chunks, "chunk")
    by_chunk = rows.groupBy("chunk")
    mail, note = "shard int, chunk int, data binary", "chunk int, kind int, data binary"
    sent = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(_opened(_send_buckets(length, chunks)), mail)
    shared = sent.repartition(chunks, "shard").groupBy("shard").applyInArrow(_shared_buckets(crowd), note).repartition(chunks, "chunk")
    first_notes = copies.unionByName(shared).repartition(chunks, "chunk")
    contexts = by_chunk.cogroup(first_notes.groupBy("chunk")).applyInArrow(_opened(_send_contexts(length, chunks)), mail)
    answers = contexts.repartition(chunks, "shard").groupBy("shard").applyInArrow(_refine(length), note)
    notes = first_notes.unionByName(answers)
    marked = by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(
        _opened(_mark(length, chunks, texts)), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    return marked.withColumnRenamed("id", id_col) if texts else marked.drop("kept").withColumnRenamed("id", id_col)
