import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    made = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
