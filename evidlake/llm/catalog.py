"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from . import problems

_NAMES = ("p2_found", "p2_records", "p5_found", "p5_nearest", "p6_found", "p6_leaks", "p7_mixture", "p7_shares", "p8_found", "p8_shares", "p8_composition")


def queries() -> dict:
    return {name: getattr(problems, name) for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    return {**problems.P2_SQL}
