"""Joins of a long table with a lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_lookup(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join ``rows`` to ``lookup`` by equal keys; ``null_safe`` lets null keys meet.

    The plan is the same whatever the sizes, and building it runs nothing: Spark broadcasts a
    side it measures to be small at run time, else shuffles and splits hot keys of the long side.
    """
    if not null_safe:
        return rows.join(lookup, list(on), how)
    side = lookup.withColumnsRenamed({key: f"_right_{key}" for key in on})
    same = [rows[key].eqNullSafe(side[f"_right_{key}"]) for key in on]
    return rows.join(side, same, how).drop(*[f"_right_{key}" for key in on])
