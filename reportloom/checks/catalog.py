"""Importing this module registers every query."""

from reportloom.checks import (  # noqa: F401
    answers, comparing, ingest, operations, retrieval, summaries, upkeep)
