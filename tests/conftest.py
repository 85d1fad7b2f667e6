import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """files((path, content)…) as repo 1."""
    def make(*rows, package_root=None):
        frame = spark.createDataFrame([(1, path, content) for path, content in rows], "repo_id bigint, path string, content string")
        if package_root is None:
            return frame
        from pyspark.sql import functions as F
        return frame.withColumn("package_root", F.lit(package_root))
    return make
