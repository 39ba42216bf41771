import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from candlewick.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def series(spark):
    """Two hourly random walks of 700 hours, one with leading nulls."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    parts = []
    for name, lead in (("a", 0), ("b", 30)):
        v = 100 + rng.normal(size=700).cumsum()
        v[:lead] = np.nan
        parts.append(pd.DataFrame({"series_id": name, "ds": pd.date_range("2024-01-01 05:00", periods=700, freq="h"), "y": v,
                                   "volume": rng.uniform(1, 9, 700)}))
    pdf = pd.concat(parts)
    from pyspark.sql import functions as F
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return pdf, df
