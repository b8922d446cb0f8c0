import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
         .config("spark.local.dir", tmp).config("spark.checkpoint.dir", f"{tmp}/ckpt").config("spark.sql.warehouse.dir", f"{tmp}/wh").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
