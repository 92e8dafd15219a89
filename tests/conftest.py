import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture
def files(spark):
    """Table of files from (path, content) pairs; the first component is the repo."""
    def make(*pairs, repo=None):
        rows = [
            (repo or path.split("/")[0], path,
             content.encode() if isinstance(content, str) else content)
            for path, content in pairs
        ]
        frame = spark.createDataFrame(rows, "repo string, path string, content binary")
        return frame.selectExpr("*", "CAST(octet_length(content) AS BIGINT) AS size")

    return make
