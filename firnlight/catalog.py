"""All queries of the radar operators and the SQL that checks them."""

from __future__ import annotations

from .operators import queries_geometry, queries_more, queries_moveout, queries_shape, queries_signal  # noqa: F401
from .plans.registry import ORACLES, QUERIES
from .sources import queries_sources  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
