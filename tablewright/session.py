"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Wall clocks are kept as UTC-session timestamps, so the session zone is part of the semantics.
# The adaptive settings are Spark's defaults, stated because the joins against lookup tables
# depend on them: run-time size checks before a broadcast, and splitting of hot join keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles of costly rows (pages, calendar texts) keep all cores; large ones follow
    # the advisory size as usual.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("tablewright").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, or one in the
    warehouse where that is unset (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def checkpoint_ready(spark: SparkSession) -> str:
    """Make ``checkpoint()`` write to the shared folder; gives that folder."""
    folder, context = shared_folder(spark), spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder
