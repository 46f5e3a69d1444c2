import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

#: One session runs all tests. What it remembers of past queries (plans as text, stages, tasks) would fill the default heap.
CONF = {
    "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
    "spark.sql.ui.retainedExecutions": "1", "spark.ui.retainedJobs": "5", "spark.ui.retainedStages": "5", "spark.ui.retainedTasks": "50", "spark.sql.maxPlanStringLength": "20000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.python.worker.reuse": "true", "spark.default.parallelism": "4", "spark.sql.files.openCostInBytes": "16m",
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]")
    for key, value in CONF.items():
        builder = builder.config(key, value)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def no_cache_left(request):
    """Tables cached by a module's tests go with it."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
