"""All queries over the driver's tables, by inventory id, with their SQL."""

from __future__ import annotations

from . import conversations, evaluation, files, flows, records, retrieval, shapes, state, stores, streams, texts  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
