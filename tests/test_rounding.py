"""Rounding of large results: by arithmetic, as SQL rounds."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.queries import catalog  # noqa: F401
from gridloom.queries.registry import QUERIES, rounded

SF = "/root/testdata/sf0.001"


def test_rounding_by_arithmetic_is_that_of_sql(spark):
    """Ties, numbers next to them, large ones and those that aren't finite."""
    rng = np.random.default_rng(0)
    ties = (rng.integers(-5000, 5000, 4000) + 0.5) / 1000
    x = np.concatenate([ties, np.nextafter(ties, 9), np.nextafter(ties, -9), rng.standard_normal(4000), rng.standard_normal(100) * 1e18, [0.0, -0.0, -0.0004, 0.00049999999999999994, 1e300, 4503599627370.4965, np.nan, np.inf, -np.inf]])
    numbers = pa.table({"k": np.arange(len(x)), "v": x})
    got = spark.createDataFrame(numbers).select("k", rounded(F.col("v"), 3).alias("v")).toArrow().sort_by("k").column("v").to_numpy()
    con = duckdb.connect()
    con.register("numbers", numbers)
    want = np.array([r[0] for r in con.execute("SELECT round(v, 3) + 0.0 FROM numbers ORDER BY k").fetchall()])
    usual = np.abs(x) < 1e12
    assert np.array_equal(got[usual], want[usual]) and not np.signbit(got[x == 0]).any()
    assert np.allclose(got[~usual], want[~usual], rtol=1e-15, atol=0, equal_nan=True)


@pytest.mark.parametrize("name", ["matmat", "apsp"])
def test_no_decimal_numbers_on_the_way(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan.upper()
