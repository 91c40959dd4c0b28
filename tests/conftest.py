from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LINE1 = (
    '0,1533036645250,301.5,812.25,-45.5,1,"Harbour Field","North Lake Airfield",'
    "-1,-12.53175,38.40721,AAA,BBB,CCC,DDD"
)
LINE2 = (
    '1,1560000015000,198.75,2210.5,133.25,2,"Old Mill Airport","Salt Plain Airport",'
    "-1,151.207345120984,-33.868901745211,hhtkq0v3m2dp,CADBDDACBBADCDBACBADDBCACDBAAC,"
    "HAGCBFEDGHACBEFDGAHCFBEDGACH,DBAFCEGDBAFCEGDBAFCEGDBAFCEG"
)


@pytest.fixture()
def feed(spark):
    """Make a frame of numbered lines."""
    return lambda *lines: spark.createDataFrame(list(enumerate(lines)), "n int, line string")
