import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-")
    builder = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    session = builder.config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tmp).config("spark.local.dir", tmp).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
