"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import answers, documents, jobs, models, ranking, references, search, store

_MODULES = [search, ranking, documents, models, references, jobs, answers, store]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
