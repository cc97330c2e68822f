import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("liftline-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def weeks(spark):
    """A calendar of n weeks with consecutive numbers."""
    def make(n, first=1):
        return spark.range(n).selectExpr(
            f"cast(id + {first} as int) AS yr_wk",
            "date_add(date'2000-01-03', cast(7 * id as int)) AS start_date",
            "date_add(date'2000-01-09', cast(7 * id as int)) AS end_date")
    return make


@pytest.fixture(scope="session")
def group_rows(spark):
    """Group panel rows from dicts; missing columns get neutral values."""
    neutral = dict(dept=1, group_code="G", yr_wk=1, qty=0.0, sales=0.0, pa_depth=0.0, ar_depth=0.0, tr_depth=0.0,
                   page_location=None, flyer_flag=0, cpp_flag=0, digital_flag=0, digest_flag=0,
                   regular_price=10.0, live_price=10.0, transactions=1.0)
    schema = ("dept int, group_code string, yr_wk int, qty double, sales double, pa_depth double, ar_depth double, "
              "tr_depth double, page_location string, flyer_flag int, cpp_flag int, digital_flag int, "
              "digest_flag int, regular_price double, live_price double, transactions double")

    def make(rows):
        return spark.createDataFrame([tuple({**neutral, **r}[k] for k in neutral) for r in rows], schema)
    return make
