"""Queries over the driver's tables, one per operator, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.registry import audits, basics, modelling, observing, persisting, timing
from tidemark.plans.ordering import Layout, measure_layout, stored_bytes, task_rows, use_layout
from tidemark.plans.ordering import SMALL_ROW_BYTES, WHOLE
from tidemark.registry.common import publish
from tidemark.sources import driver_tables as D

MODULES = [basics, observing, timing, modelling, audits, persisting]


_LAYOUTS: dict[tuple, Layout] = {}


def _layout(spark: SparkSession, sf_dir: str) -> Layout:
    """Planned once per dataset, on the table and key with the largest series."""
    events = D.events(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, task_rows(events))
    if key not in _LAYOUTS:
        small = stored_bytes(events)
        if small is not None and small <= task_rows(events) * SMALL_ROW_BYTES:
            _LAYOUTS[key] = WHOLE
        else:
            _LAYOUTS[key] = measure_layout(events, ["event_type"], "ts")
    return _LAYOUTS[key]


def _published(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Instants are compared as UTC wall time.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        use_layout(spark, _layout(spark, sf_dir))
        return publish(query(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _published(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
