import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duelframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="duelframe-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bout_rows(spark):
    """Build a bout table from (id, day, red, blue, winner, red value, blue value)."""

    def build(rows):
        return spark.createDataFrame(
            rows, "bout_id long, Date date, RedFighter string, BlueFighter string, Winner string, RedX double, BlueX double"
        )

    return build
