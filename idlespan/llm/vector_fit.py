"""Packing documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths, since attention is masked
to a document).  Pieces are taken longest first.  Of the sequences in which a piece fits by every capacity, the one with the
smallest weighted norm of what would be left is chosen (``score="norm"``), or the one whose residual has the largest weighted dot
product with the piece (``"dot"``).  Pieces are dealt into blocks of bounded size by a hash and each block is packed in one task, so the
waste is at most a few unfilled sequences per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts_for, saved
from .tokens import MEMORY_WORDS, shared_encoder, slices_of

TOKENS = 2048
WEIGHTS = (1.0, 0.05, 0.05)
BLOCK_PIECES = 8192


def _cut(tokenizer: str, keeps_space: bool, tokens: int, memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of the texts of each batch; few texts at a time leave Arrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or shared_encoder(tokenizer, keeps_space, memory)
            for some in slices_of(batch, "text"):
                found = zip(some.column("id").to_pylist(), encoder.encode(some.column("text").to_pylist()))
                rows = [(name, at // tokens, at, len(cut := ids[at:at + tokens]), zlib.crc32(cut.tobytes()))
                        for name, ids in found for at in range(0, len(ids), tokens)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                    names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer: str, keeps_space: bool, tokens: int = TOKENS, id_col: str = "doc_id",
           text_col: str = "text", memory: int = MEMORY_WORDS) -> DataFrame:
    """Pieces of at most ``tokens`` ids: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``.  A null text is empty (the end id alone).

    A worker keeps the ids of ``memory`` different words, some 150 bytes each; the others are encoded anew, which gives the same ids."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _cut(tokenizer, keeps_space, tokens, memory), "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float],
             score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length (descending).  A length that exceeds a capacity alone gets a sequence alone."""
    cap = np.array([tokens, documents, attention], float)
    weight = np.array(weights)
    left = np.empty((3, len(lengths)))                                  # residual capacities, as shares
    at, offset, filled = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    names = np.empty(len(lengths), np.int64)                            # of the open sequences
    live = used = 0
    shortest = lengths[-1] / tokens if len(lengths) else 0
    eps = 1e-12
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length]) / cap
        rest = left[:, :live] - need[:, None]
        fits = np.flatnonzero((rest >= -eps).all(axis=0))
        if len(fits):
            if score == "dot":
                k = fits[np.argmax((weight * need) @ left[:, fits])]
            else:
                k = fits[np.argmin(weight @ rest[:, fits] ** 2)]
            left[:, k] -= need
        else:
            k, live = live, live + 1
            left[:, k], names[k] = 1 - need, used
            used += 1
        at[i], offset[i] = names[k], filled[names[k]]
        filled[names[k]] += length
        if left[0, k] < shortest - eps:                                 # nothing that comes can enter: close it
            live -= 1
            left[:, k], names[k] = left[:, live], names[live]
    return at, offset


def pack(items: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
         weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", block: int = BLOCK_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``id``, ``piece``, ``length``.

    ``documents`` and ``attention`` (the sum of squared lengths) bind where they are given.  By default they are as many documents as a sequence has
    tokens, and the attention of one document that fills it: a sequence within its tokens is within both, and they only decide between
    sequences.  Lower ones need more sequences.  Of equal scores the sequence that comes first among the open ones is taken.
    Repeated rows are pieces of their own.
    """
    documents, attention = documents or tokens, attention or tokens * tokens
    blocks = parts_for(items.count(), block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        at, offset = best_fit(pdf["length"].to_numpy(), tokens, documents, attention, weights, score)
        return pdf.assign(sequence_id=pdf["block"].to_numpy(np.int64) * (1 << 32) + at, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", block int, sequence_id long, offset long"
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, fields).drop("block")


def pack_documents(docs: DataFrame, tokenizer: str, keeps_space: bool, tokens: int = TOKENS, id_col: str = "doc_id",
                   text_col: str = "text", memory: int = MEMORY_WORDS, **capacities) -> DataFrame:
    """One row per piece of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Only documents longer than ``tokens`` are cut.  A null or empty text is one piece with the end id.  Rows with a null id or a repeated
    id are packed like any other, other columns are ignored, an empty table gives no piece.
    """
    cut = saved(pieces(docs, tokenizer, keeps_space, tokens, id_col, text_col, memory), "pieces")
    return pack(cut, tokens, **capacities).withColumnRenamed("id", id_col)
