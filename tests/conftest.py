import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("keyloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over literal rows and return the tuples."""

    def run(names, rows, *exprs):
        schema = ", ".join(f"{n} string" for n in names.split())
        df = spark.createDataFrame(rows, schema)
        return [tuple(r) for r in df.select(*exprs).collect()]

    return run


@pytest.fixture
def make_vars(spark):
    """Variables table from {project: {key: value}} with one file per project."""

    def build(projects):
        rows = [
            (p, p, i + 1, k, v) for p, kv in projects.items() for i, (k, v) in enumerate(kv.items())
        ]
        return spark.createDataFrame(rows, "project_id string, file_id string, pos int, key string, value string")

    return build


@pytest.fixture
def make_files(spark):
    def build(rows):
        """rows: (project_id, path, content[, mode])"""
        full = [(r[0], f"{r[0]}/{r[1]}", r[1], r[2], r[3] if len(r) > 3 else None) for r in rows]
        return spark.createDataFrame(
            full, "project_id string, file_id string, path string, content string, mode int"
        )

    return build
