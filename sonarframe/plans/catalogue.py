"""The query catalogue: each query binds operators to the driver's tables, with the same result in SQL beside it."""

from . import experiments, models, recordings, signals, spectra, statistics
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "experiments", "models", "recordings", "signals", "spectra", "statistics"]
