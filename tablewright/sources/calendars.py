"""Calendar texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.calendar import parse_events
from .menus import read_snapshot_texts


def read_ics(spark: SparkSession, path: str, dialect: str = "strict") -> DataFrame:
    """Events of every calendar file under ``path``."""
    return parse_events(read_snapshot_texts(spark, path), ["snapshot_id"], dialect=dialect)
