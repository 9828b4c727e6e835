"""The registered queries and, by the same names, their SQL."""

from __future__ import annotations

from kbflow.plans import admissions, corpora, curation, evaluation, loop, memory, projections, retrieval, streams  # noqa: F401
from kbflow.plans.register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
