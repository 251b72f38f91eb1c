"""Imports every family of queries so that they register themselves."""

from tapeworks.plans import auction_queries, feed_queries, fill_queries, match_queries, source_queries, tape_queries, trial_queries, vol_queries  # noqa: F401
from tapeworks.plans.registry import ORACLES, QUERIES  # noqa: F401
