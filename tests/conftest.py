"""One local session for all tests."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={scratch} -Djava.io.tmpdir={scratch}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"
