"""Every registered query of the library and its SQL."""

from __future__ import annotations

from .operators import analytics, blocks, catalog, commands, delivery, jobs, joins, keyvalue, lake, listing, manifests, objects, queues, reports, scans, statistics, streams, tables  # noqa: F401
from .registry import ORACLES, QUERIES, Query
from .sources import files  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
