"""The registered queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from ebbline.catalog import cleaning, learning, reports, stated, tables, texts  # noqa: F401  (they register themselves)
from ebbline.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
