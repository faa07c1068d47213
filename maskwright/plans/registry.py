"""All queries of the library and their SQL."""

from __future__ import annotations

from . import artifacts, detection, evidence, structures, tables

_MODULES = [detection, tables, artifacts, evidence, structures]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
