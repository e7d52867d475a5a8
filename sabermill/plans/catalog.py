"""All queries of the engine."""

from sabermill.plans import calibration, features, feeds, history, maintenance, models, offers, profiles, quotes, resolution, scoring, training  # noqa: F401
from sabermill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
