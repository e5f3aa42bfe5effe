"""All registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from marlstone.plans import classics, graphs, pages, populations, retrieval, streams, upkeep

_PARTS = (retrieval, graphs, pages, upkeep, streams, classics, populations)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
