"""Registered queries: every operator over the shared test tables, with its SQL twin."""

from . import catalog, data_scores, experiments, fairness, features, models, sampling, scorecards, staleness  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
