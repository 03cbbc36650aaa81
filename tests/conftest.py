import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Panel maker: {"name": [y, ...]} from 2020-01-01 on."""
    import datetime as dt

    def make(data, parts=None):
        rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), v) for k, ys in data.items() for i, v in enumerate(ys)]
        kind = "double" if any(isinstance(r[2], float) for r in rows) else "bigint"
        df = spark.createDataFrame(rows, f"unique_id string, ds date, y {kind}")
        return df.repartition(parts) if parts else df

    return make


def values(df, col, order="ds"):
    return [r[0] for r in df.orderBy("unique_id", order).select(f"`{col}`").collect()]
