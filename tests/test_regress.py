"""HAC errors of a long series against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import regress


def test_long_series_uses_all_its_lags(spark):
    n, lags = 400_000, 25
    t = np.arange(n, dtype=np.int64)
    x, y = (t * 7919 % 1013).astype(float), (t // 40 * 31 % 97 + t * 7919 % 1013).astype(float)
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 1013).cast("double").alias("x"), (F.floor(F.col("id") / 40) * 31 % 97 + F.col("id") * 7919 % 1013).cast("double").alias("y"))
    beta, alpha = np.polyfit(x, y, 1)
    g = (y - alpha - beta * x) * (x - x.mean())
    total = g @ g + sum(2 * (1 - k / (lags + 1)) * (g[k:] @ g[:-k]) for k in range(1, lags + 1))
    got = regress.ols(rows, ("k",)).first()
    assert got["se_beta"] == pytest.approx(np.sqrt(total) / ((x - x.mean()) ** 2).sum(), rel=1e-9)
    assert regress.ols(rows.limit(0), ("k",)).count() == 0


def test_several_regressors_of_few_rows(spark):
    """Keys of 5 to 7 rows against numpy; with 2 rows there is nothing left for the second regressor, or what
    rounding leaves; one row explains nothing."""
    rng = np.random.default_rng(3)
    data = [(f"n{n}", i, *(float(v) for v in rng.integers(-50, 50, 4))) for n in (1, 2, 5, 6, 7, 8) for i in range(n)]
    df = spark.createDataFrame(data, "k string, t long, x1 double, x2 double, x3 double, y double")
    got = {r["k"]: r["r2"] for r in regress.r2_of_few(df, ("k",), ["x1", "x2", "x3"], "y").collect()}
    assert sorted(got) == ["n1", "n2", "n5", "n6", "n7"] and np.isnan(got["n1"]) and not got["n2"] < 1 - 1e-9
    for n in (5, 6, 7):
        own = np.array([r[2:] for r in data if r[0] == f"n{n}"])
        a, y = np.column_stack([np.ones(n), own[:, :3]]), own[:, 3]
        left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert got[f"n{n}"] == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum(), rel=1e-9)
