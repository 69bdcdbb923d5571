import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    # The texts that the expected results belong to.
    bodies = ["python search engine", "java index structure", "python java hybrid", "search index ranking", "python search index fast", "python java search index"]
    return spark.createDataFrame([(i, f"t{i}", f"u{i}", b) for i, b in enumerate(bodies)], "doc_id long, title string, url string, body string")


@pytest.fixture
def index(corpus):
    from lexshard.functions.analyzer import RAW
    from lexshard.operators.index import build_index

    return build_index(corpus, RAW)
