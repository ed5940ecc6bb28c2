"""Query registry: a Spark plan and, where SQL can say it, the statement it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, shared_folder


class Tables:
    """Benchmark tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files. A plain stream path must be a folder; a pattern
        matches a single file as well."""
        schema = getattr(self, name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")

    def scratch(self) -> str:
        """A fresh folder in the shared location."""
        return f"{shared_folder(self.spark)}/{uuid.uuid4()}"


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        REGISTRY[build.__name__] = Query(build, sql)
        return build

    return add
