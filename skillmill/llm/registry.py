"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import canonical, encoding, frequency, garbled, neardup, packing, pii, sameform

MODULES = (pii, neardup, frequency, sameform, canonical, encoding, packing, garbled)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
