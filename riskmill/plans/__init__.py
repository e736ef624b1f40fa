"""Jobs composed of operators, and the registered queries over the given tables."""

from riskmill.plans.registry import QUERIES, SQL  # noqa: F401
from riskmill.plans import (  # noqa: F401
    evaluation_queries,
    ledger_queries,
    retrieval_queries,
    scan_queries,
    serving_queries,
    stream_queries,
)
