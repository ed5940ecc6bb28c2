"""Small dimension tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..fixed_values import CROSSWALK


def crosswalk_dim(spark: SparkSession, pairs: dict[str, str] | None = None, inverse: bool = False) -> DataFrame:
    """``source_name, target_name``; the inverse swaps the two.

    An Arrow table becomes a local relation, whose size Spark knows when it plans a join.
    """
    listed = CROSSWALK if pairs is None else pairs
    columns = [pa.array(listed.keys(), pa.string()), pa.array(listed.values(), pa.string())]
    return spark.createDataFrame(pa.table(columns[::-1] if inverse else columns, names=["source_name", "target_name"]))


def read_nutrition_lookup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(by_restaurant, by_item) as written by ``write_nutrition_lookup``."""
    return spark.read.parquet(f"{path}/by_restaurant"), spark.read.parquet(f"{path}/by_item")
