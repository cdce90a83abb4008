import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumetrics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "plumetrics-tests", master="local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
        spark__driver__memory="6g", spark__default__parallelism=4,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a small DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
