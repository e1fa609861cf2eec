"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query name and the module of this subpackage that holds it under the same name.
NAMES = {
    "p1_found": "names",
    "p2_found": "survivor",
    "p2_survivors": "survivor",
    "p2_observations": "survivor",
    "p3_found": "addresses",
    "p4_found": "components",
    "p6_found": "entities",
    "p6_matches": "entities",
    "p7_ids": "encode",
    "p9_found": "abuse",
    "p9_scores": "abuse",
    "p9_rates": "abuse",
    "p8_mixture": "mixture",
    "p8_shares": "mixture",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from weftline.llm.oracle import SQL

    return dict(SQL)
