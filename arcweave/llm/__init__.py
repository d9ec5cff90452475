"""Corpus operators for training-data pipelines. Nothing outside this package imports it."""

from __future__ import annotations

import importlib

#: Modules whose QUERIES and ORACLE_SQL are registered, in the order of the operators' numbers.
MODULES = ("url_filter", "toxicity", "token_counts", "langid", "sharding", "near_dedup", "quality", "packing", "license_scan", "decontam")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").ORACLE_SQL
    return found
