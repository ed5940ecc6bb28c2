import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablewright import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column function over python values given as one row per tuple."""

    def run(rows, schema, build):
        frame = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, " + schema)
        return [row["out"] for row in frame.select("n", build(frame).alias("out")).orderBy("n").collect()]

    return run
