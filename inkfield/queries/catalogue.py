"""All queries of the core, and their SQL."""

from __future__ import annotations

from inkfield.queries import compaction, difficulty, evaluation, flows, texts

_PARTS = (difficulty, texts, evaluation, flows, compaction)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
