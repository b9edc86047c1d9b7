import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from bidscope.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = get_spark(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(folder)}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression on a single row."""

    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value
