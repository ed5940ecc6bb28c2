"""Monthly timetable responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = """
data ARRAY<STRUCT<
  timings: MAP<STRING, STRING>,
  date: STRUCT<
    gregorian: STRUCT<date: STRING>,
    hijri: STRUCT<day: STRING, year: STRING, month: STRUCT<en: STRING>>>>>
"""


def read_timetable_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per day of each response (a file, or a line), with ``timings`` and ``date`` as stored."""
    raw = spark.read.schema(RESPONSE).option("multiLine", multi_line).json(path)
    return raw.select(F.col("_metadata.file_path").alias("snapshot_id"), F.inline("data"))
