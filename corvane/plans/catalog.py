"""Every query of the engine by name, with its SQL counterpart."""

from __future__ import annotations

from corvane.plans import answers, blocks, conversations, ingestion, layout, relational, retrieval, streams, study, usage
from corvane.plans.registry import QUERIES, SQL, Query

_MODULES = (retrieval, answers, relational, ingestion, blocks, layout, conversations, usage, streams, study)

#: Name of the query that entry() runs.
FLAGSHIP = "retrieval_hybrid"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
