"""Quantiles of a window that slides over ordered rows.

``percentile(...).over(frame)`` builds and sorts a map of up to ``lookback`` values for every row.  Here the rows of a partition, in order, are read
as arrays: the windows of an Arrow batch are one strided matrix, sorted row by row in numpy, and the last ``lookback`` values go on to
the next batch.  No more than a batch and its windows is in memory, however long a path is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..scale import CHUNK, CHUNK_ROWS, HALO

ROWS = 4096


def _quantiles(window: np.ndarray, counts: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of sorted windows whose last values are missing; by the same sum as ``percentile``."""
    place = q * np.maximum(counts - 1, 0)
    low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    rows = np.arange(len(counts))
    at_low, at_high = window[rows, low], window[rows, high]
    found = np.where(low == high, at_low, (high - place) * at_low + (place - low) * at_high)
    return np.where(counts > 0, found, np.nan)


def sliding_quantiles(df: DataFrame, key: Sequence[str], index: str, value: str, out: dict[str, float], lookback: int = 100,
                      causal: bool = True, splits=None, chunk: int = CHUNK_ROWS, count: str = "_n") -> DataFrame:
    """Add quantiles ``out`` (name to share; null on an empty window) and the ``count`` of values of the window of each row.

    The window holds the ``lookback`` rows before a row (``causal``), or ends at it; null values are in it but do not count.  ``index`` is the dense
    0-based row number per key.  With splits a key is cut into chunks of rows, each with the last rows of the one before.
    """
    key = list(key)
    if splits is None:
        spread, parts = df.withColumn(HALO, F.lit(False)), key
    else:
        size = max(chunk, lookback)
        own = F.floor(F.col(index) / size)
        spread = df.withColumn(CHUNK, F.explode(F.when(F.col(index) % size >= size - lookback, F.array(own, own + 1)).otherwise(F.array(own))))
        spread, parts = spread.withColumn(HALO, F.col(CHUNK) != own), [*key, CHUNK]
    spread = spread.withColumns({"_group": F.xxhash64(*parts, F.lit(0)), "_value": F.col(value).cast("double")})
    dealt = spread.repartition(*parts) if parts else spread.repartition(1)
    names = df.columns
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in out], StructField(count, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, groups = np.full(lookback, np.nan), np.zeros(lookback, np.int64)
        fresh = np.zeros(lookback, bool)                                   # the first rows have nothing before them
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                n = part.num_rows
                v = np.r_[values, part.column("_value").to_numpy(zero_copy_only=False).astype(np.float64)]
                g = np.r_[groups, part.column("_group").to_numpy(zero_copy_only=False)]
                known = np.r_[fresh, np.ones(n, bool)]
                first = 0 if causal else 1
                seen = np.lib.stride_tricks.sliding_window_view(v, lookback)[first:first + n].copy()
                same = np.lib.stride_tricks.sliding_window_view(g, lookback)[first:first + n] == g[lookback:, None]
                same &= np.lib.stride_tricks.sliding_window_view(known, lookback)[first:first + n]
                seen[~same] = np.nan
                seen.sort(axis=1)                                          # missing values come last
                counts = lookback - np.isnan(seen).sum(axis=1)
                keep = ~part.column(HALO).to_numpy(zero_copy_only=False)
                added = [pa.array(x, mask=np.isnan(x)) for x in (_quantiles(seen, counts, q) for q in out.values())]
                made = pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *added, pa.array(counts)], names=[*names, *out, count])
                yield made if keep.all() else made.filter(pa.array(keep))
                values, groups, fresh = v[n:], g[n:], known[n:]
    return dealt.sortWithinPartitions(*parts, index).mapInArrow(run, schema)
