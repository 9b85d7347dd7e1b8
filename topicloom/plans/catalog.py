"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from topicloom.plans import q_files, q_ingest, q_io, q_ml, q_ngrams, q_runs, q_text, q_timeseries, q_vectors  # noqa: F401
from topicloom.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
