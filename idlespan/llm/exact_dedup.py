"""Exact deduplication that a hot text cannot slow down.

1. Every map task merges equal texts of its own rows (the partial side of the first aggregate).
2. The survivors meet in (digest, salt) groups, so the copies of one text are spread over ``salts`` tasks.
3. The winners of the salts meet by digest alone: at most ``salts`` rows per text, whatever the number of copies.

All three stages group by the full normalised text; the digest only decides where rows meet.  Documents find their
group by digest.  A digest that stands for several texts is found in stage 3, and its documents are joined on the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ascii_lower, saved, unused, whole_text

SALTS = 32


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, text, largest id, rows."""
    merged = (rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
              .groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")))
    return (merged.repartition("digest").groupBy("digest", "norm")
            .agg(F.max("keep").alias("keep"), F.sum("size").alias("size")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     normalise: Callable[[Column], Column] = ascii_lower,
                     digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Texts are equal when their normalised forms are; a null text counts as empty.  The row with the largest id stays.
    A null id counts in the group but loses to any other id; a group of null ids alone keeps them (``keep_id`` null).
    Rows that repeat an id with an equal text are the same document: all of them carry ``kept`` true if their id wins.
    Other columns of ``docs`` are ignored, so their names cannot clash.  An empty table gives an empty table.
    """
    norm = normalise(whole_text(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    groups = saved(_winners(rows, salts).groupBy("digest")
                   .agg(F.count(F.lit(1)).alias("texts"), F.max("keep").alias("keep"), F.sum("size").alias("size")),
                   "exact-groups")
    plain = groups.filter("texts = 1").drop("texts")
    found = rows.select("id", "digest").join(plain, "digest")
    shared = groups.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        clash = rows.join(shared, "digest")
        found = found.unionByName(clash.join(_winners(clash, salts), ["digest", "norm"])
                                  .select("digest", "id", "keep", "size"))
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that lose their group: columns and order of columns as they came.

    Rows repeated with the same id and an equal text leave one row.
    """
    digest = options.get("digest", sha256)(options.get("normalise", ascii_lower)(whole_text(text_col)))
    row_id, row_digest, keep_id, keep_digest, copies = (unused(docs, c) for c in ("row_id", "row_digest", "keep_id", "keep_digest", "copies"))
    found = duplicate_groups(docs, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias(keep_id), F.col("digest").alias(keep_digest))
    keepers = saved(found.groupBy(keep_id, keep_digest).agg(F.count(F.lit(1)).alias(copies)), "keepers")
    marked = docs.withColumns({row_id: F.col(id_col), row_digest: digest})
    kept = marked.join(keepers, F.col(row_id).eqNullSafe(F.col(keep_id)) & (F.col(row_digest) == F.col(keep_digest)))
    if not keepers.filter(F.col(copies) > 1).isEmpty():        # only rows that repeat an id with its text meet again
        again = kept.filter(F.col(copies) > 1).dropDuplicates([row_id, row_digest])
        kept = kept.filter(F.col(copies) == 1).unionByName(again)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
