import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", at).config("spark.sql.warehouse.dir", f"{at}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def six_days(spark):
    """Six reports on six days, with every column that the bundle needs."""
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 3, 1, 9) + timedelta(days=i), ["HIGH", "LOW", "MEDIUM"][i % 3], f"c{i % 2}", "k" if i % 2 else None, i, "Monday", {"toxicity": i / 10}) for i in range(6)]
    return spark.createDataFrame(rows, "id long, timestamp timestamp, risk_level string, county string, matched_keyword string, hour_of_day int, day_of_week string, scores map<string,double>")
