"""Token ids in files: one concatenated id array with Elias-Fano document boundaries.

A file row holds a part of the corpus: ascending documents, their ids side by side, and where each document ends.  Ends are
non-decreasing, so each is split into low bits, stored packed, and a high part in unary: end i sets bit (end_i >> low) + i
of a bitmap.  That takes about 2 + log2(ids / documents) bits per document instead of 64.  Selecting the i-th set bit, with the
position of every ``SAMPLE``-th one stored, gives one boundary without decoding the others.  Document ids are ascending too
and stored the same way.  Parts lie in Parquet files with one binary column, so any store that Spark reads can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved
from .tokens import batches_of, shared_encoder

SAMPLE = 64
PART_IDS = 1 << 22
LIST_HEAD, PART_HEAD = struct.Struct("<QBQQQ"), struct.Struct("<4sBQqQQQ")
MAGIC = b"EFID"


class EliasFano:
    """A non-decreasing list of integers from 0 to 2**64 - 1."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bitmap[ones] = 1
        each = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(each.astype(np.uint8).reshape(-1), bitorder="little"),
                   np.packbits(bitmap, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Position of the i-th set bit of the bitmap: from the sample before it, byte by byte."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        value = int(self.high[byte]) >> at % 8 << at % 8
        while value.bit_count() <= left:
            left -= value.bit_count()
            byte += 1
            value = int(self.high[byte])
        for _ in range(left):
            value &= value - 1
        return 8 * byte + (value & -value).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            low |= (int(self.low[k // 8]) >> k % 8 & 1) << b
        return self.select(i) - i << self.low_bits | low

    def values(self) -> np.ndarray:
        """The whole list."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        return LIST_HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + \
            self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, low_bits, low, high, samples = LIST_HEAD.unpack_from(data)
        data = data[LIST_HEAD.size:]
        ends = np.cumsum([low, high, 4 * samples]).tolist()
        return cls(n, low_bits, np.frombuffer(data[:ends[0]], np.uint8), np.frombuffer(data[ends[0]:ends[1]], np.uint8),
                   np.frombuffer(data[ends[1]:ends[2]], "<u4")), data[ends[2]:]


class Part:
    """The documents of one file row."""

    def __init__(self, data: bytes):
        magic, width, self.nulls, self.first, n_docs, n_ids, _ = PART_HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, rest = EliasFano.from_bytes(memoryview(data)[PART_HEAD.size:])
        self.names, rest = EliasFano.from_bytes(rest)
        self.ids = np.frombuffer(rest, f"<u{width}", n_ids)
        self.n = n_docs

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
        """``doc_ids`` ascending, nulls first."""
        named = [d for d in doc_ids if d is not None]
        first = named[0] if named else 0
        ends = np.cumsum([len(x) for x in ids])
        return PART_HEAD.pack(MAGIC, width, len(doc_ids) - len(named), first, len(doc_ids), int(ends[-1]), 0) + \
            EliasFano.of(ends).to_bytes() + EliasFano.of(np.array([d - first for d in named], np.uint64)).to_bytes() + \
            np.concatenate(ids).astype(f"<u{width}").tobytes()

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, by two selections."""
        return self.ids[self.ends[i - 1] if i else 0:self.ends[i]]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.first + int(x) for x in self.names.values()]


def write_parts(docs: DataFrame, tokenizer: str, width: int, keeps_space: bool, id_col: str = "doc_id",
                text_col: str = "text", part_ids: int = PART_IDS) -> DataFrame:
    """Encode every text (null: empty), append id 0, and write ascending parts: ``section``, ``part``, ``n_ids``, ``payload``.

    Documents are range-partitioned by id, so sections and their parts ascend; a part closes at about ``part_ids`` ids.  Null ids
    come first, rows that repeat an id lie side by side, other columns are ignored, an empty table gives no part.
    ``tokenizer`` is a path on every executor; ``width`` is the bytes of an id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, section, part, names, held, size = None, TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()),
                                               pa.array([Part.pack(names, held, width)], pa.binary())],
                                              names=["section", "part", "n_ids", "payload"])
        for batch in batches:
            encoder = encoder or shared_encoder(tokenizer, keeps_space)
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for start, stop in batches_of(texts):
                for name, found in zip(ids[start:stop], encoder.encode(texts[start:stop])):
                    names.append(name)
                    held.append(found.astype(f"<u{width}"))
                    size += len(found)
                    if size >= part_ids:
                        yield row()
                        part, names, held, size = part + 1, [], [], 0
        if names:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text")).repartitionByRange("id", "tag").sortWithinPartitions("id", "tag")
    return saved(rows.select("id", "text").mapInArrow(run, "section int, part int, n_ids long, payload binary"), "token-parts")


def read_documents(parts: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the parts: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (of its
    ids as little-endian unsigned 32-bit integers), and the ``ids`` themselves if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section, part, data in zip(*(batch.column(c).to_pylist() for c in ("section", "part", "payload"))):
                held = Part(data)
                ends = held.ends.values().astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                ids = [held.ids[a:b].astype("<u4") for a, b in zip(starts, ends)]
                out = [pa.array([section] * held.n, pa.int32()), pa.array([part] * held.n, pa.int32()),
                       pa.array(held.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts),
                       pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["section", "part", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    fields = "section int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = parts.select("section", "part", "payload").mapInArrow(run, fields)
    sizes = parts.select("section", "part", "n_ids")
    before = Window.orderBy("section").rowsBetween(Window.unboundedPreceding, -1)      # one row per written partition
    sections = sizes.groupBy("section").agg(F.sum("n_ids").alias("n")).select(
        "section", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sections_before"))
    inside = Window.partitionBy("section").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("parts_before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(sections, "section") \
        .select("section", "part", (F.col("sections_before") + F.col("parts_before")).alias("base"))
    kept = ["n_tokens", "ids_crc32", *["ids"] * with_ids]
    return docs.join(offsets, ["section", "part"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), *kept)


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer; a cluster passes its own path to the operators."""
    import public_tokenizers
    return public_tokenizers.path(name)


def open_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts written earlier."""
    return spark.read.schema("section int, part int, n_ids long, payload binary").parquet(path)
