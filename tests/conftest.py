from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.catalog.frames import Frames  # noqa: E402
from fleetlens.session import prepare  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fleetlens-tests")
        .config("spark.ui.enabled", "false")
        # No Python call site per column expression: plans build faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def frames(spark):
    return Frames(spark, SMALL)


def as_set(df, *columns):
    names = columns or df.columns
    return {tuple(row[c] for c in names) for row in df.collect()}


def at(seconds: float):
    """A readable time: seconds after 2024-01-01."""
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=seconds)
