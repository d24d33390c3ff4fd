"""Intermediate tables are dropped in time."""

import os
import subprocess
import sys
from pathlib import Path

from spanledger import session


def test_tables_of_a_scope(spark):
    def path(df):
        return df._spanledger_path.removeprefix("file://")

    outside = session.materialize(spark.range(3))
    with session.temporary_tables(spark):
        inside = session.materialize(spark.range(5))
        assert inside.count() == 5 and os.path.exists(path(inside))
    assert not os.path.exists(path(inside)) and outside.count() == 3
    session.release(outside)
    assert not os.path.exists(path(outside))


def test_tables_go_when_the_driver_ends_after_a_stop(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from spanledger import session
session.materialize(spark.range(3))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=200, capture_output=True)
    assert list(tmp_path.glob("t-*")) == []  # Spark makes a folder of its own there
