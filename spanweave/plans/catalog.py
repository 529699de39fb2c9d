"""All queries of the library's own operators by name, and their oracles."""

from __future__ import annotations

from . import assembly, audit, detection, intervals, relations, streams

MODULES = (detection, intervals, audit, relations, assembly, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
