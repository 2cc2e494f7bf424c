"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, problems, reference

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in (
        "p1_found", "p1_counts",
        "p3_found", "p3_records", "p3_questions", "p3_cells", "p3_evidence", "p3_annotations",
        "p4_found", "p4_amounts", "p4_unit_switches",
    ):
        out[name] = getattr(problems, name)
    for name in reference.NAMES:
        out[name] = getattr(reference, name)
    return out


def oracle_sql() -> dict[str, str]:
    return {**problems.P1_SQL, **problems.P3_SQL, **problems.P4_SQL, **oracles.oracle_sql()}
