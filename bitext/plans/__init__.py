"""Registered queries (Spark plan + DuckDB oracle SQL per query)."""

from . import q_bleu, q_experiments, q_measure, q_metrics, q_models, q_split, q_text, q_vocab  # noqa: F401
from .registry import FULL, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "FULL"]
