"""The query registry: one entry per operator of the inventory.

``queries()`` maps a key to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()``
maps the same key to DuckDB SQL over the driver's tables. Keys without SQL get
the weaker rows-only check (unit goldens cover them in tests/).
"""

from __future__ import annotations

import importlib

_MODULES = ["page_queries", "image_queries", "block_queries", "table_queries", "sink_queries"]


def _load(attr):
    out = {}
    for m in _MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{m}"), attr))
    return out


def queries():
    return _load("QUERIES")


def oracle_sql():
    return _load("ORACLE")
