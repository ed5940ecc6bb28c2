"""Every registered query agrees with its SQL on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as contract  # noqa: E402
import check_queries  # noqa: E402

FOLDER = os.environ.get("TABLES_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no benchmark tables")


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, name):
    outcome = check_queries.compare(spark, FOLDER, name)
    assert outcome.startswith(("ok", "rows only")) and "TYPE" not in outcome, outcome


def test_entry(spark):
    assert 0 < contract.entry(spark).count() <= 10
