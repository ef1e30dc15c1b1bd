import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
                      spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def table(spark):
    """table("a int, b string", rows) with ISO text accepted for timestamps."""
    def make(schema, rows):
        from pyspark.sql import types as T
        st = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else schema
        plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(
            f.dataType, (T.TimestampNTZType, T.TimestampType, T.DecimalType)) else f.dataType) for f in st.fields])
        df = spark.createDataFrame([tuple(r) for r in rows], plain)
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in st.fields])
    return make


@pytest.fixture
def rows():
    def get(df, *order):
        return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return get
