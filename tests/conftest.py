import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from resrisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pairs(spark):
    """Frame of (label, score, cost) rows."""
    def make(y, p, cost=None):
        cost = cost or [0.0] * len(y)
        return spark.createDataFrame(
            list(zip(y, p, map(float, cost))),
            "is_canceled int, cancel_probability double, fn_cost double")
    return make
