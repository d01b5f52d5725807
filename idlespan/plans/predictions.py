"""Predictions that SQL can repeat: trailing survival of earlier gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import trailing_survival
from . import adapter as A
from .registry import PATH, Timeline, timeline


def trailing_predictions(spark: SparkSession, sf_dir: str) -> tuple[Timeline, DataFrame]:
    tl = timeline(spark, sf_dir)
    p = trailing_survival(tl.gaps, A.HORIZONS, PATH, splits=tl.splits)
    return tl, p.withColumn("label", (F.col("duration_ns") >= F.col("horizon_ns")).cast("int"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
