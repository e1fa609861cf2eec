"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from weftline.operators import geo
from weftline.plans import records, resolution, scans


def queries() -> dict[str, Callable]:
    """Every query of the core by name."""
    return {"p5_found": geo.p5_found} | resolution.QUERIES | records.QUERIES | scans.QUERIES


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express."""
    return resolution.SQL | records.SQL | scans.SQL
