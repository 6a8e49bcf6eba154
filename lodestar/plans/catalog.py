"""Imports every query module, so that all registrations have run."""

from lodestar.plans import (  # noqa: F401
    event_queries,
    experiment_queries,
    feature_queries,
    model_queries,
    ranking_queries,
    stateful_queries,
    stream_queries,
)
from lodestar.plans.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
