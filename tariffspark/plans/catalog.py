"""Query modules; importing them registers their queries."""

from . import comparisons, dedups, extraction, matching, reviews, scalars, streams  # noqa: F401
