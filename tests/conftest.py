import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quire.session import BASE_CONF, ensure_checkpoint_dir, ship_package
    b = (SparkSession.builder.master("local[*]").appName("quire-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s


@pytest.fixture()
def scratch():
    """A fresh folder per test (never cleared, never reused)."""
    return tempfile.mkdtemp(prefix="quire-test-")
