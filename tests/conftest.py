from __future__ import annotations

import tempfile

import pytest

from corvane.session import SETTINGS, session

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    extra = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-")}
    s = session("tests", "local[4]", **(SETTINGS | extra))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
