import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.schema import TABLES  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402
from ledgerloom.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g pyspark-shell")
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__maxMetadataValueLength="2000",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Builds Tables from rows given as dicts; absent columns are null."""

    def value(v, data_type):
        return Decimal(str(v)) if v is not None and data_type.typeName() == "decimal" else v

    def build(**tables):
        frames = {}
        for name, rows in tables.items():
            schema = TABLES[name].schema
            data = [tuple(value(r.get(f.name), f.dataType) for f in schema) for r in rows]
            frames[name] = spark.createDataFrame(data, schema)
        return Tables(spark, frames)

    return build


@pytest.fixture
def rows():
    def collect(df):
        return [r.asDict() for r in df.collect()]

    return collect
