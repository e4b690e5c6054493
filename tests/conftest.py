import os

import pytest
from pyspark.sql import SparkSession

from placewright import Gazetteer
from tests.fixtures import write_dumps


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dumps(tmp_path_factory):
    return write_dumps(tmp_path_factory.mktemp("dumps"))


@pytest.fixture(scope="session")
def gazetteer(spark, dumps, tmp_path_factory):
    built = Gazetteer.build(spark, str(dumps / "places.txt"), str(dumps / "alternates.txt"))
    return built.save(str(tmp_path_factory.mktemp("saved") / "gazetteer"))
