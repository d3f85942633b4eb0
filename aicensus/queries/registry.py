"""All registered queries."""

from __future__ import annotations

from . import assembly, corpora, detection, overlays

_MODULES = [assembly, detection, corpora, overlays]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
