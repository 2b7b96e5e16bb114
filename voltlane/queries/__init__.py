"""All registered queries, by name."""

from voltlane.queries import cleaning, intervals, metrics, models, profiles, ranking, sampling, series, sources, spectra, streaming  # noqa: F401
from voltlane.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
