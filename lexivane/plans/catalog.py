"""All registered queries and their reference SQL."""

from __future__ import annotations

from lexivane.plans import comparison, evaluation, pipelines, preparation, retrieval, vocabulary

_PARTS = (preparation, vocabulary, retrieval, evaluation, comparison, pipelines)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: statement for part in _PARTS for name, statement in part.ORACLES.items()}
