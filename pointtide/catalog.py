"""Queries of the core, by name, and their SQL."""

from __future__ import annotations

from .plans import coding, data_quality, edits, evaluated, evaluation, frames, measures, ordered, paths, profile, selection, streams

_MODULES = (coding, data_quality, edits, evaluated, evaluation, frames, measures, ordered, paths, profile, selection, streams)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
