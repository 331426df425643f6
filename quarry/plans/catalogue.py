"""Named queries over the driver's tables, and the SQL each is compared with."""

from __future__ import annotations

from quarry.plans import event_queries, image_queries, report_queries, similarity_queries, stream_queries, text_queries  # noqa: F401 - they register
from quarry.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
