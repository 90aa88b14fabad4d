"""Importing this module registers every query."""

from __future__ import annotations

from . import aggregates, graphs, joining, limits_sets, ordered, planning, scalars, scoring, selections, sources_sinks, streams, tracing  # noqa: F401
from .registry import CHECK, RUN, SURVEY  # noqa: F401

FLAGSHIP = "account_profile"
