"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.intervals import build_timeline
from ..scale import Splits, plan_splits
from ..session import shared_dir
from . import adapter as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PATH = ["path"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


class Timeline(NamedTuple):
    transfers: DataFrame
    busy: DataFrame
    gaps: DataFrame
    splits: Splits | None


def timeline(spark: SparkSession, sf_dir: str, path: str = "event_type") -> Timeline:
    """Transfers, busy intervals and gaps by path, with the skew check done once on the source."""
    t = A.transfers(spark, sf_dir, path)
    splits = plan_splits(t, "start_ns", PATH)
    busy, gaps = build_timeline(t, PATH, A.MIN_PROBE, A.MARGIN, splits)
    return Timeline(t, busy, gaps, splits)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
