"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import q_leaks, q_nearcopies, q_neighbours, q_packing, q_scans, q_splitting, q_subjects, q_terms, q_tokens

_MODULES = [q_splitting, q_scans, q_packing, q_nearcopies, q_terms, q_neighbours, q_tokens, q_leaks, q_subjects]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
