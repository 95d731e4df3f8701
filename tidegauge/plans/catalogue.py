"""All registered queries."""

from tidegauge.plans import (  # noqa: F401
    alert_queries,
    health_queries,
    ingest_queries,
    report_queries,
    rollup_queries,
    state_queries,
    stored_queries,
    stream_queries,
)
from tidegauge.plans.registry import QUERIES  # noqa: F401
