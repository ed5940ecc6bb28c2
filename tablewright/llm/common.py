"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_ready

# White space that parts words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

# Rows and bytes handed to Python at once, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, checkpoints in the shared folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    checkpoint_ready(spark)
    return spark


# Shuffle files of an execution go when it ends, not when the driver next collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint, without the shuffle files that went into it."""
    conf = rows.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        return rows.select("*").checkpoint()  # the setting holds for frames made under it; ``rows`` may be used again
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)


def without(rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """``rows`` without columns of these names in any letter case: they give way to the
    operator's own columns."""
    taken = {name.lower() for name in names}
    kept = [name for name in rows.columns if name.lower() not in taken]
    return rows if len(kept) == len(rows.columns) else rows.select(*[quoted(name) for name in kept])


def quoted(name: str):
    """Column of exactly this name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.select(*[quoted(name) for name in names])
