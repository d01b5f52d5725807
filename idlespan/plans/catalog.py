"""Every registered query; importing the modules fills the registry."""

from . import (q_columns, q_features, q_intervals, q_models, q_policies, q_sources, q_stats, q_streaming)  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
