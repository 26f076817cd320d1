import numbers
import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


def same_rows(got, want) -> None:
    """Equal columns and rows, in any order; floats to six digits."""

    def rows(df):
        def text(v):
            if pd.api.types.is_scalar(v) and pd.isna(v):
                return "~"
            if isinstance(v, numbers.Real) or type(v).__name__ == "bool_":
                return f"{float(v):.6f}" if abs(float(v)) < 2**53 else str(int(v))
            return str(v)

        return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
