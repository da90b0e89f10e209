"""Every query by its key, and its SQL."""

from __future__ import annotations

from . import queries_audit, queries_edges, queries_logs, queries_reports, queries_search, queries_site

_MODULES = [queries_logs, queries_search, queries_site, queries_audit, queries_reports, queries_edges]

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
