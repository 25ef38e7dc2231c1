"""Tiled solve against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import panel, tiles


def system(spark, n, width):
    """Entries exp(−|a−b|/width) of a positive definite matrix, its right side, and both as arrays."""
    name = lambda c: F.format_string("S%05d", c)
    a = spark.range(n).select(F.col("id").alias("p"))
    pairs = a.select("p", F.explode(F.sequence(F.col("p"), F.lit(n - 1))).alias("q"))
    cov = pairs.select(name(F.col("p")).alias("a"), name(F.col("q")).alias("b"), F.exp(-(F.col("q") - F.col("p")) / F.lit(float(width))).alias("cov"))
    vector = a.select(name(F.col("p")).alias("symbol"), F.sin(F.col("p").cast("double")).alias("v"))
    at = np.arange(n)
    return cov, vector, np.exp(-np.abs(at[:, None] - at[None, :]) / width), np.sin(at.astype(float))


@pytest.mark.parametrize("n, tile, bound", [(1, 4, tiles.BROADCAST_BYTES), (40, 256, tiles.BROADCAST_BYTES), (90, 16, tiles.BROADCAST_BYTES), (60, 25, 0)])
def test_small_systems(spark, n, tile, bound):
    cov, vector, matrix, v = system(spark, n, 5)
    got = tiles.solve(cov, vector, ridge=1e-6, tile=tile, broadcast_bytes=bound).orderBy("symbol").toPandas()["w"].to_numpy()
    assert np.allclose(got, np.linalg.solve(matrix + 1e-6 * np.eye(n), v), rtol=1e-8, atol=1e-9)


def test_three_thousand_symbols(spark):
    cov, vector, matrix, v = system(spark, 3000, 40)
    got = tiles.solve(cov, vector, tile=600).orderBy("symbol").toPandas()["w"].to_numpy()
    assert len(got) == 3000 and np.abs((matrix + 1e-8 * np.eye(3000)) @ got - v).max() < 1e-8


def test_indefinite_missing_and_empty(spark):
    rows = [("A", "A", 1.0), ("A", "B", 3.0), ("B", "B", 1.0), ("C", "C", 2.0), ("A", "X", 9.0)]
    cov = spark.createDataFrame(rows, "a string, b string, cov double")
    vector = spark.createDataFrame([("A", 1.0), ("B", 0.0), ("C", 4.0)], "symbol string, v double")
    want = {"A": -0.125, "B": 0.375, "C": 2.0}
    for tile in (1, 3):
        assert {r["symbol"]: r["w"] for r in tiles.solve(cov, vector, 0.0, tile).collect()} == pytest.approx(want)
    assert tiles.solve(cov, vector.limit(0)).count() == 0


def test_kelly_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.02, (200, 30)) + rng.normal(0, 0.01, (200, 1))
    long = [(int(t), f"S{k:02d}", float(x[t, k])) for t in range(200) for k in range(30)]
    got = panel.kelly_weights(spark.createDataFrame(long, "ts long, symbol string, ret double"), fraction=0.01, max_single=9.0, max_gross=99.0)
    want = np.linalg.solve(np.cov(x.T) + 1e-8 * np.eye(30), 0.01 * x.mean(axis=0))
    assert np.allclose(got.orderBy("symbol").toPandas()["w"], want, rtol=1e-6)


def test_blocks_do_not_change_sums(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 23))
    long = spark.createDataFrame([(t, f"S{k:02d}", float(x[t, k])) for t in range(40) for k in range(23)], "ts long, symbol string, ret double")
    monkeypatch.setattr(panel, "BLOCK_SYMBOLS", 5)  # five blocks
    got = {(r["a"], r["b"]): r["corr"] for r in panel.correlations(long).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 23 * 22 // 2 and all(got[f"S{i:02d}", f"S{j:02d}"] == pytest.approx(want[i, j]) for i in range(23) for j in range(i + 1, 23))
