import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
