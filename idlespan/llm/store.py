"""Tables between the steps of an operator, and the tables that the queries read."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SLOTS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs one stage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: str) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def parts_for(total: int | float | None, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``."""
    return max(least, math.ceil((total or 0) / each))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, nulls: bool = False) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``gone``; with ``nulls`` a null id there takes the null ids.

    Only rows whose id shares one of ``SLOTS`` hash slots with an id of ``gone`` are shuffled to meet it; the marked slots are a bitmap of
    at most SLOTS / 8 bytes, which every task gets.  The other rows, most of them as a rule, stay where they are with their texts.
    """
    name, part, bits = (unused(docs, c) for c in ("gone", "gone_part", "gone_bits"))
    gone = saved(gone.toDF(name).distinct(), "gone")
    kind = gone.schema[name].dataType

    def slot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SLOTS))
    marks = gone.groupBy(F.bitmap_bucket_number(slot(F.col(name))).alias(part)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot(F.col(name)))).alias(bits))
    place = slot(docs[id_col].cast(kind))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.col(bits).substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    met = docs.join(F.broadcast(marks), F.bitmap_bucket_number(place) == F.col(part), "left")
    maybe = met.filter(marked).drop(part, bits)
    own = maybe[id_col].cast(kind)
    stay = maybe.join(gone, own.eqNullSafe(F.col(name)) if nulls else own == F.col(name), "left_anti")
    return met.filter(~marked).drop(part, bits).unionByName(stay)
