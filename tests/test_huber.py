"""Huber regression: passes over all tasks against the fit in one group, and its estimating equation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import regress


def series(spark, symbol, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 0.3 + x @ [1.5, -0.7] + rng.standard_t(2, n)
    return [(symbol, k, float(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(n)]


COLUMNS = "symbol string, ts long, y double, a double, b double"


def test_passes_equal_groups(spark):
    rows = series(spark, "A", 300, 1) + series(spark, "B", 90, 2) + [("C", k, 2.0 * k, float(k), float(k % 3)) for k in range(40)] + series(spark, "D", 4, 3)
    df = spark.createDataFrame(rows, COLUMNS)
    one, passes = ({r["symbol"]: r for r in regress.huber_newey_west(df, "y", ["a", "b"], keys=["symbol"], group_rows=g).collect()} for g in (10_000, 50))
    assert set(one) == set(passes) == {"A", "B", "C"}
    for symbol in ("A", "B"):
        for c in ("coef", "se", "tstat", "pvalue"):
            assert passes[symbol][c] == pytest.approx(one[symbol][c], rel=1e-6, abs=1e-9), c
        assert passes[symbol]["r2"] == pytest.approx(one[symbol]["r2"]) and passes[symbol]["n"] == one[symbol]["n"]


def test_long_series(spark):
    n = 50_000
    rows = series(spark, "A", n, 5)
    fit = regress.huber_newey_west(spark.createDataFrame(rows, COLUMNS), "y", ["a", "b"], keys=["symbol"]).first()
    y, x = np.array([r[2] for r in rows]), np.column_stack([np.ones(n), np.array([r[3:] for r in rows])])
    r = y - x @ fit["coef"]
    psi = np.clip(r / (np.median(np.abs(r)) / regress.MAD), -regress.HUBER_C, regress.HUBER_C)
    assert np.abs(x.T @ psi).max() / np.abs(psi).sum() < 1e-6
    assert fit["coef"] == pytest.approx([0.3, 1.5, -0.7], abs=0.05)


def test_nothing_to_fit(spark):
    df = spark.createDataFrame(series(spark, "A", 4, 3), COLUMNS)
    assert regress.huber_newey_west(df, "y", ["a", "b"], keys=["symbol"]).count() == 0
    # residuals all zero: the first fit stays
    flat = spark.createDataFrame([("A", k, 1.0 + 2.0 * k, float(k), float(k % 3)) for k in range(60)], COLUMNS)
    assert regress.huber_newey_west(flat, "y", ["a", "b"], keys=["symbol"], group_rows=10).first()["coef"] == pytest.approx([1.0, 2.0, 0.0], abs=1e-6)
