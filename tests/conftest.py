import datetime as dt
import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def bars(spark):
    """Makes a bar table of one or more assets from lists of closes, one business day apart."""

    def make(closes, key="X", start=dt.date(2020, 1, 1), **columns):
        series = closes if isinstance(closes, dict) else {key: closes}
        rows = []
        for k, values in series.items():
            day = start
            for i, v in enumerate(values):
                while day.weekday() > 4:
                    day += dt.timedelta(1)
                rows.append((k, dt.datetime(day.year, day.month, day.day), None if v is None else float(v), *(columns[c][i] for c in columns)))
                day += dt.timedelta(1)
        extra = "".join(f", {c} double" for c in columns)
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, f"asset_key string, date timestamp_ntz, close double{extra}")
        return df.withColumn("adj_close", F.col("close"))

    return make


@pytest.fixture(scope="session")
def values():
    """A column of a one-asset table in date order."""

    def get(df, name, order="date"):
        return [r[name] for r in df.orderBy(order).select(name).collect()]

    return get
