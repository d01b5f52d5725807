"""Exact top-k by inner product with MaxScore.

Every dimension is a term and its column of the shard a posting list with a smallest and a largest value, so a query knows what each
term can add at most.  Terms are split by that bound: the non-essential ones together cannot lift a vector to the
k-th best score known.  Essential postings are traversed for all vectors of the shard; the others are probed, largest bound first, only
for vectors that can still compete.  Queries in blocks meet shards of vectors in a grid of bounded cells, and the cells' winners are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import parts_for

SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
SCALE = 256
PROBE = 8
EXACT = 2.0**53


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, or null if the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def best(postings: np.ndarray, query: np.ndarray, k: int, seeds: int = 64, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``postings`` (terms x vectors) that can be among the k best for ``query``, ties included, and their scores."""
    low, high = postings.min(axis=1), postings.max(axis=1)
    most, least = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
    order = np.argsort(most - least, kind="stable")                       # terms by what they can add above their least
    ids = np.arange(postings.shape[1]) if allowed is None else np.flatnonzero(allowed)
    if not len(ids):
        return ids, np.zeros(0)

    def kth(at: np.ndarray) -> float:
        scores = query @ postings[:, at]
        return np.partition(scores, len(at) - k)[len(at) - k] if len(at) >= k else -np.inf
    bar = kth(ids[:seeds])
    reach = least.sum() + np.cumsum((most - least)[order])                # of a vector with nothing above least in later terms
    split = int(np.searchsorted(reach, bar, "left"))                      # terms before it are non-essential
    rest, essential = order[:split][::-1], order[split:]
    part = query[essential] @ postings[essential] if len(essential) else np.zeros(postings.shape[1], postings.dtype)
    part = part[ids]
    top = ids[np.argpartition(part, max(0, len(part) - seeds))[-seeds:]]
    bar = max(bar, kth(top))
    at = 0
    while True:
        alive = part + most[rest[at:]].sum() >= bar
        ids, part = ids[alive], part[alive]
        if at >= len(rest):
            return ids, part
        terms = rest[at:at + PROBE]
        part = part + query[terms] @ postings[np.ix_(terms, ids)]
        at += PROBE


def _cell(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()

        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("vector").combine_chunks()
            return flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        data, asked = matrix(vectors), matrix(queries)
        if not data.shape[1]:
            data, asked = np.zeros((len(data), 1), np.int64), np.zeros((len(asked), 1), np.int64)
        names, out = vectors.column("id").to_numpy(), []
        if float(np.abs(data).max()) * float(np.abs(asked).max()) * data.shape[1] < EXACT:
            data, asked = data.astype(np.float64), asked.astype(np.float64)   # exact there, and faster
        postings = np.ascontiguousarray(data.T)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        for name, query in zip(queries.column("id").to_pylist(), asked):
            lo, hi = np.searchsorted(ordered, name, "left"), np.searchsorted(ordered, name, "right")
            allowed = None
            if hi > lo:                                                       # the query's own row is no candidate
                allowed = np.ones(len(names), bool)
                allowed[order[lo:hi]] = False
            at, scores = best(postings, query, k, allowed=allowed)
            first = np.lexsort((names[at], -scores))[:k]
            out.append((np.full(len(first), name), names[at][first], scores[first].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], schema=schema)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k largest integer inner products, ties to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.  Only vectors of one length are
    compared.  Rows that repeat an id are candidates of their own but never for a query of that id, and a repeated query
    is asked once.  Fewer candidates than k give them all; an empty table gives none.  Scores must fit a long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).filter("id is not null and vector is not null")
    rows = rows.withColumn("dims", F.size("vector"))
    asked = rows.filter("asks").dropDuplicates(["id"])
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    shards, blocks = parts_for(counts.n, shard_rows), parts_for(counts.q, block_queries)

    def deal(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "vector", "dims", deal(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("id", "vector", "dims", deal(blocks).alias("block"), every(shards).alias("shard"))
    cell = ["shard", "block", "dims"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
