"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import asked, assembly, bundles, corpus, layout, purchases, records, sections, worded

PLANS = (purchases, corpus, records, asked, sections, assembly, worded, layout, bundles)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for plan in PLANS for name, q in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for plan in PLANS for name, q in plan.sql().items()}
