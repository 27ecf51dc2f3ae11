from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zealmark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "local[8]", 2, spark__checkpoint__dir=shared, spark__driver__memory="4g", spark__driver__host="127.0.0.1"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Frame from rows and a schema string; text in timestamp columns is parsed."""

    def make(rows, schema: str):
        df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
        for field in schema.split(","):
            name, kind = field.split()
            if kind == "timestamp_ntz":
                df = df.withColumn(name, df[name].cast("timestamp_ntz"))
        return df

    return make


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="session")
def collected():
    return rows
