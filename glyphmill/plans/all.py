"""Importing this module registers every query."""

from glyphmill.plans import (  # noqa: F401
    correction,
    curation,
    evaluation,
    feeds,
    profiling,
    series,
    serving,
    sources,
    text,
)
from glyphmill.plans.catalog import CATALOG  # noqa: F401
