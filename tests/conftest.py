import glob
import os

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return c


def line(ip="10.0.0.1", time="01/Jan/2025:00:00:00 +0000", request="GET /index.html HTTP/1.1", status=200, size="100", referer="-", agent="Mozilla/5.0"):
    return f'{ip} - frank [{time}] "{request}" {status} {size} "{referer}" "{agent}"'


@pytest.fixture(scope="session")
def make_line():
    return line


@pytest.fixture
def lines(spark):
    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "id long, value string")

    return make
