from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from watchlake.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one_row(spark):
    """Evaluate expressions over one value per test row: returns the list of results."""

    def run(values, expression, schema="value string"):
        rows = [(position, value) for position, value in enumerate(values)]
        df = spark.createDataFrame(rows, f"pos int, {schema}").repartition(1)
        result = df.select("pos", expression.alias("result")).orderBy("pos").collect()
        return [row["result"] for row in result]

    return run
