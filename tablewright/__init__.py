"""tablewright: profile, clean, chart, model and cluster tables on Spark."""

from .operators.cache import release_cached  # noqa: F401

__version__ = "0.1.0"
