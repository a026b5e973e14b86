"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from braidsieve.plans import keyed, overlap, pairs, reports, truth

_PARTS = (overlap, reports, pairs, truth, keyed)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
