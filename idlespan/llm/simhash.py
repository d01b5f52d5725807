"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared only inside buckets: rows that agree on some bits (a table is a set of bits).  With a radius r and the
bits cut into r + k bands, taking every choice of k bands as a table finds every pair within r; ``sampled_tables`` draws tables for
radii too wide for that.  Inside a bucket the fingerprints are stored vertically, 64 to a word: plane b holds bit b of 64
members.  One query against a word updates 64 distances at once with carry-save counters, and words in which every member is
past the radius are dropped as the planes go by.  Equal fingerprints are one node, a bucket's links leave the task as a spanning
forest, and a bucket above ``CELL`` members is cut into blocks that meet two by two, so a hot bucket is many bounded tasks.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import saved, without_ids

SEED = 42
CELL = 2048
ENTRIES = 1 << 16
PLANES = 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints -------------------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text with fewer words is one shingle, one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()       # bytes.lower changes A-Z alone
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1)[: len(found) - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set if it is set in over half of the hashes; none: zero.  As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i:i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Independent hashes for a further fingerprint word."""
    h = hashes ^ np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    for factor, shift in ((0xFF51AFD7ED558CCD, 33), (0xC4CEB9FE1A85EC53, 33)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                 length: int = 1, distinct: bool = False) -> DataFrame:
    """``id``, the fingerprint words ``w0`` ... (``length`` words of 64 bits) and ``n``, the hashes behind them, of every row.

    ``distinct`` counts a repeated shingle once, for comparing sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                h = np.unique(h) if distinct else h
                rows.append([majority(h), *[majority(remixed(h, w)) for w in range(1, length)], len(h)])
            data = np.array(rows, np.int64).reshape(-1, length + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(data[:, w]) for w in range(length + 1)]], names=["id", *names])

    names = [*[f"w{w}" for w in range(length)], "n"]
    fields = ", ".join(["id long", *[f"{n} long" for n in names]])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


# ---- comparison ---------------------------------------------------------------------------------------------------------

def banded_tables(radius: int, bits: int = 64, spare: int = 3) -> list[list[int]]:
    """Masks, one list of words per table, that together find every pair within ``radius``."""
    bands = radius + spare
    edges = [bits * i // bands for i in range(bands + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [_words(sum(c), bits) for c in combinations(masks, spare)]


def sampled_tables(tables: int, width: int, bits: int, seed: int = SEED) -> list[list[int]]:
    """Masks of ``width`` bits drawn at random."""
    rng = random.Random(seed)
    return [_words(sum(1 << b for b in rng.sample(range(bits), width)), bits) for _ in range(tables)]


def _words(mask: int, bits: int) -> list[int]:
    return [(mask >> 64 * w) & (2**64 - 1) for w in range(bits // 64)]


def _past(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits set where the distance counted so far is over the radius."""
    above, equal = over, ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def near_pairs(prints: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal ``group`` (sorted) whose rows of ``prints`` (uint64, n x words) differ in <= radius bits."""
    n = len(prints)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    per = -(-size // 64)                                                           # words of each group
    base = np.r_[0, np.cumsum(per)[:-1]]
    of = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[of]
    word, lane = base[of] + place // 64, (place % 64).astype(np.uint64)
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])                     # first member of every word
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, begin)
    bits = 64 * prints.shape[1]

    def plane(b: int) -> np.ndarray:
        bit = (prints[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        return np.bitwise_or.reduceat(bit << lane, begin)

    planes = np.stack([plane(b) for b in range(bits)])
    later = base[of] + per[of] - word                                              # own word and those after it
    stops = np.cumsum(later)
    lo = 0
    while lo < n:                                                                  # blocks of about ENTRIES (query, word) entries
        hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + ENTRIES, "right")))
        query = np.repeat(np.arange(lo, hi), later[lo:hi])
        step = np.arange(len(query)) - np.repeat(np.r_[0, np.cumsum(later[lo:hi])[:-1]], later[lo:hi])
        target = word[query] + step
        open_ = valid[target] & np.where(step == 0, ~((np.uint64(2) << lane[query]) - np.uint64(1)), FULL)
        some = open_ != 0
        query, target, open_ = query[some], target[some], open_[some]
        counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(query), np.uint64)
        for b in range(bits):
            flip = np.uint64(0) - ((prints[query, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
            carry = planes[b][target] ^ flip
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if b % PLANES == PLANES - 1:                                           # abandon words that are wholly past the radius
                left = open_ & ~_past(counters, over, radius)
                some = left != 0
                query, target, open_, over = query[some], target[some], left[some], over[some]
                counters = [c[some] for c in counters]
        hit = np.unpackbits(open_.view(np.uint8), bitorder="little").reshape(-1, 64)
        entry, bit = np.nonzero(hit)
        yield query[entry], begin[target[entry]] + bit
        lo = hi


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item that the pairs connect it with."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            if (low == label[i]).all() and (low == label[j]).all():
                break
            for side in (i, j):
                np.minimum.at(label, label[side], low)
                np.minimum.at(label, side, low)
            label = label[label]
    while True:
        nxt = label[label]
        if (nxt == label).all():
            return label
        label = nxt


def _bucket_forests(words: int, radius: int):
    """Over rows sorted by ``key``: the spanning links of every bucket.  A bucket cut by a batch edge waits for its rest."""
    def links(key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        run = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(run)
        some = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        node, prints, group = node[some], prints[some], group[some]
        label = forest(len(node), near_pairs(prints, group, radius)) if len(node) else np.zeros(0, np.int64)
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = (cols[0], cols[1], np.stack(cols[2:], 1).view(np.uint64).reshape(-1, words))
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if cut:
                yield links(*(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
        if held is not None and len(held[0]):
            yield links(*held)
    return run


def link_forest(nodes: DataFrame, tables: Sequence[Sequence[int]], radius: int, cell: int = CELL, by_size: bool = False) -> DataFrame:
    """Edges ``u``, ``v`` that connect the nodes (``node``, ``w0`` ...) within ``radius`` as the full set of links would.

    ``by_size`` also parts a table by ``n`` into classes of a factor of two, with edges of its own in every table.
    """
    words = len(tables[0])
    rng = random.Random(SEED)
    shift = [rng.random() for _ in tables]
    names = [f"w{w}" for w in range(words)]

    def key(t: int) -> Column:
        signed = [m - 2**64 if m >= 2**63 else m for m in tables[t]]
        size = [F.coalesce(F.floor(F.log2("n") + shift[t]), F.lit(-1))] if by_size else []
        return F.xxhash64(F.lit(t), *size, *[F.col(n).bitwiseAND(F.lit(m).cast("long")) for n, m in zip(names, signed)])

    rows = nodes.select(F.explode(F.array(*[key(t) for t in range(len(tables))])).alias("key"), "node", *names)
    hot = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell), "hot-buckets")
    if not hot.isEmpty():
        blocks = F.ceil(F.col("n") / (cell // 2)).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        met = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64("key", F.least(b, own), F.greatest(b, own)))
        cut = rows.join(hot, "key").select(F.explode(met).alias("key"), "node", *names)
        rows = rows.join(hot, "key", "left_anti").select("key", "node", *names).unionByName(cut)
    return (rows.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_bucket_forests(words, radius), "u long, v long").distinct())


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    radius: int = 2, cell: int = CELL) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Rows are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id reachable (null
    ids are skipped; null if there is no other).  Null and empty texts and texts without words have fingerprint zero and
    are linked like any other.  Repeated rows give repeated results, other columns are ignored, an empty table gives none.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = saved(prints.groupBy(F.col("w0")).agg(F.min("id").alias("low")).withColumn("node", F.col("w0")), "nodes")
    labels = components(link_forest(nodes.select("node", "w0"), banded_tables(radius), radius, cell))
    member = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = saved(member.select("node", "label", "low"), "members")
    lowest = member.groupBy("label").agg(F.min("low").alias("component_id"))
    named = member.join(lowest, "label").select(F.col("node").alias("w0"), "component_id")
    return prints.join(named, "w0").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity ------------------------------------------------------------------------------------------

WIDE, WIDE_RADIUS = 4, 60
WIDTH, PER_BUCKET, AGREE, RECALL = 12, 64, 0.84, 0.998
BLOCK = 256


def wide_tables(nodes: int) -> list[list[int]]:
    """Tables for fingerprints of ``WIDE`` words.

    A table's bits grow with the logarithm of the nodes, so buckets keep their size, and the tables with them, so that a pair that agrees
    in ``AGREE`` of its bits (two sets at similarity 0.8) meets in one of them with probability ``RECALL``.
    """
    width = max(WIDTH, math.ceil(math.log2(max(1, nodes) / PER_BUCKET)))
    return sampled_tables(math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE ** width)), width, 64 * WIDE)


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two sets share, from products of blocks of their incidence matrix; elements of one set are left out."""
    value, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = times > 1
    number = np.cumsum(several) - 1
    some = several[element]
    column, owner = number[element[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(column, [low, low + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += block @ block.T
    return total


def _verified(similarity: float):
    """Over rows sorted by ``key``: spanning links between sets whose Jaccard similarity reaches ``similarity``."""
    def links(nodes: list[int], sets: list[np.ndarray]) -> np.ndarray:
        if len(nodes) < 2:
            return np.zeros((0, 2), np.int64)
        size = np.array([len(s) for s in sets], np.float64)
        same = shared_counts(sets)
        linked = same >= similarity * (size[:, None] + size[None, :] - same)
        label = forest(len(nodes), iter([np.nonzero(np.triu(linked, 1))]))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        named = np.array(nodes, np.int64)
        return np.stack([named[moved], named[label[moved]]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            out = links(nodes, sets)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])
        for batch in batches:
            for key, node, data in zip(*batch.columns):
                if key.as_py() != now:
                    yield flush()
                    now, nodes, sets = key.as_py(), [], []
                nodes.append(node.as_py())
                sets.append(np.frombuffer(data.as_py(), np.uint64))
        yield flush()
    return run


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``node`` and the sorted distinct shingle hashes of ``text`` as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(data, pa.binary())], names=["node", "data"])
    return docs.select("node", "text").mapInArrow(run, "node long, data binary")


# ---- the pairs that no table proposes -----------------------------------------------------------------------------------

SAMPLE, SEEN, COMMON = 16, 4, 1 << 16
CLASSES, FULL = 96, 255


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The shingles that most rows of a sample hold, rarest first.  They only order the prefixes: any list gives the same links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["key"])
    part = docs.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node", "text").mapInArrow(run, "key long")
    top = part.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "key").limit(COMMON)
    return np.array([r.key for r in top.select("key").collect()][::-1], np.int64).view(np.uint64)


def prefix_length(n: int, similarity: float) -> int:
    """Sets of ``n`` and more elements that reach the similarity share one of so many first elements of any common order."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def class_counts(h: np.ndarray) -> bytes:
    """How many of a set's elements fall into each of ``CLASSES`` classes, a byte each; ``FULL`` stands for that many or more."""
    return np.minimum(np.bincount((h % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), FULL).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """``key``, ``node``, ``n`` and ``place`` of the first shingles of every text, common ones last, else by hash; and one row a text at
    place -1 with its ``counts`` by class."""
    order = np.argsort(common)
    known, rank = common[order], order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                key, node, size, place, counts = [], [], [], [], []
                for id_, text in zip(batch.column("node")[low:low + 256].to_pylist(), batch.column("text")[low:low + 256]):
                    h = np.unique(shingle_hashes(text.as_py(), words))
                    if not len(h):
                        continue
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.argsort(np.where(known[at] == h, rank[at], 0), kind="stable")]
                    m = prefix_length(len(h), similarity)
                    key.append(np.r_[h[:1], h[:m]])
                    node.append(np.full(m + 1, id_, np.int64))
                    size.append(np.full(m + 1, len(h), np.int32))
                    place.append(np.arange(-1, m, dtype=np.int32))
                    counts += [class_counts(h), *[None] * m]
                if key:
                    cols = [np.concatenate(key).view(np.int64), *[np.concatenate(x) for x in (node, size, place)]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(counts, pa.binary())],
                                                     names=["key", "node", "n", "place", "counts"])
    return docs.select("node", "text").mapInArrow(run, "key long, node long, n int, place int, counts binary")


def _prefix_pairs(similarity: float):
    """Over rows sorted by ``key``: pairs of different labels whose sizes and places leave room for the similarity."""
    def pairs(key: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        found, many = [], 0
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            own, size, left = label[a:b], n[a:b].astype(np.float64), (n[a:b] - place[a:b]).astype(np.float64)
            for low in range(0, b - a, 256):                                       # the first shared element stands before all others
                rows = slice(low, low + 256)
                least = similarity / (1 + similarity) * (size[rows, None] + size[None, :]) - 1e-6
                fits = (np.minimum(left[rows, None], left[None, :]) >= least) & (own[rows, None] != own[None, :])
                i, j = np.nonzero(fits & (np.arange(b - a)[None, :] > np.arange(low, min(low + 256, b - a))[:, None]))
                u, v = node[a:b][low + i], node[a:b][j]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
                many += len(u)
                if many >= ENTRIES:
                    yield batch_of(found)
                    found, many = [], 0
        if many:
            yield batch_of(found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            yield from pairs(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield from pairs(*held)
    return run


def _can_reach(similarity: float):
    """The rows (u, v, a, b) whose counts by class ``a`` and ``b`` leave room for the similarity: no class shares more than the lesser count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int64) for c in "ab")
            room = np.minimum(a, b).sum(axis=1) >= similarity / (1 + similarity) * (a.sum(axis=1) + b.sum(axis=1)) - 1e-6
            unknown = (a == FULL).any(axis=1) | (b == FULL).any(axis=1)
            yield batch.select(["u", "v"]).filter(pa.array(room | unknown))
    return run


def _similar(similarity: float):
    """The rows (u, v, a, b) whose sets ``a`` and ``b`` reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(same >= similarity * (len(a) + len(b) - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def missed_links(docs: DataFrame, labels: DataFrame, words: int, similarity: float, cell: int = CELL) -> DataFrame:
    """All links (``u``, ``v``) at the similarity between different ``labels`` (``node``, ``label``; a node without one is its own).

    Two sets that reach the similarity share one of their first elements (``prefix_length``) of any common order, so rows that share
    one are compared, with no chance in it.  Common shingles come last in that order; a shingle that still has over ``cell`` rows
    is cut into blocks that meet two by two.  Pairs meet small counts by class first, and only those that these cannot rule out meet
    their whole sets.
    """
    stored = saved(prefixes(docs, words, similarity, common_shingles(docs, words)), "prefixes")
    first = stored.filter("place >= 0").drop("counts")
    met = first.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    rows = first.join(met, "key").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "n", "place")
    rows = saved(rows, "shared-prefixes")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_a"), F.max("label").alias("_b"))
    several = saved(several.filter("_a < _b").select("key", "_n"), "mixed-prefixes")
    rows = rows.join(several, "key")
    blocks = F.when(F.col("_n") > cell, F.ceil(F.col("_n") / (cell // 2))).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64("key", F.least(b, own), F.greatest(b, own)))
    rows = rows.select(F.explode(cells).alias("key"), "node", "label", "n", "place")
    pairs = saved(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_prefix_pairs(similarity), "u long, v long").distinct(),
                  "prefix-pairs")
    counts = stored.filter("place < 0").select("node", "counts").distinct()
    pairs = saved(pairs.join(counts.select(F.col("node").alias("u"), F.col("counts").alias("a")), "u")
                  .join(counts.select(F.col("node").alias("v"), F.col("counts").alias("b")), "v")
                  .select("u", "v", "a", "b").mapInArrow(_can_reach(similarity), "u long, v long").distinct(), "likely-pairs")
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = saved(shingle_sets(docs.join(asked, "node", "left_semi"), words), "asked-sets")
    return (pairs.join(sets.select(F.col("node").alias("u"), F.col("data").alias("a")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("data").alias("b")), "v")
            .select("u", "v", "a", "b").mapInArrow(_similar(similarity), "u long, v long").distinct())


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                  similarity: float = 0.8, radius: int = WIDE_RADIUS, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``docs`` with the smallest id of every group of near copies; columns as they came.

    A group is a component of the graph that links texts whose sets of ``words``-word shingles (A-Z lower-cased) have Jaccard
    similarity ``similarity`` or more.  256-bit fingerprints within ``radius`` in random tables propose candidate groups, and the shingle
    sets decide.  What the tables do not propose is found by ``missed_links``, so every link is.  Candidate groups above
    ``block`` members are verified block by block, two by two.
    Texts without words are one group.  Rows with a null id cannot be named, so they all stay; rows that repeat an id stay or
    go together; an empty table gives none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).filter("node is not null")
    prints = saved(fingerprints(own, "node", "text", words, WIDE, distinct=True), "wide-fingerprints")
    names = [*[f"w{w}" for w in range(WIDE)], "n"]
    nodes = saved(prints.groupBy(*names).agg(F.min("id").alias("node")), "wide-nodes")
    guess = components(link_forest(nodes, wide_tables(nodes.count()), radius, cell, by_size=True))
    member = nodes.join(guess, "node", "left").select(*names, F.coalesce("label", "node").alias("label"))
    member = saved(prints.join(member, names).select(F.col("id").alias("node"), "label").distinct(), "wide-members")
    several = member.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chosen = member.join(several, "label")
    sets = saved(shingle_sets(own.join(chosen.select("node"), "node", "left_semi"), words).join(chosen, "node"), "shingle-sets")
    blocks = F.ceil(F.col("n") / block).cast("int")
    place = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64("label", F.least(b, place), F.greatest(b, place)))
    cells = sets.select(F.explode(met).alias("key"), "node", "data")
    edges = cells.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_verified(similarity), "u long, v long")
    linked = saved(components(edges), "near-labels")
    missed = missed_links(own, linked, words, similarity, cell)
    linked = components(linked.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(missed))
    return without_ids(docs, id_col, linked.filter("node != label").select("node"))
