import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Three symbols of random bars with flat stretches and a zero-volume day."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("000001", 260), ("600002", 150), ("300003", 40)):
        close = 20.0 * np.exp(np.cumsum(rng.normal(0, 0.04, n)))
        for i in range(n):
            c = float(close[i if not 60 <= i < 75 else 60])
            o = float(c * (1 + rng.normal(0, 0.02))) if not 60 <= i < 75 else c
            h, low = max(o, c) * (1.0 if 60 <= i < 75 else 1.01), min(o, c) * (1.0 if 60 <= i < 75 else 0.99)
            rows.append((s, f"{s}.txt", dt.date(2022, 1, 3) + dt.timedelta(days=i), o, h, low, c, 0.0 if i == 5 else float(rng.integers(100, 999)), 1e6))
    schema = "symbol string, file string, date date, open double, high double, low double, close double, volume double, amount double"
    return spark.createDataFrame(rows, schema).cache()
