import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = (
        SparkSession.builder.master("local[8]")
        .appName("tickloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    yield session.prepare(built)
    built.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tickloom-test-")
