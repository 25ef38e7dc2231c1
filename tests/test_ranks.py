"""Ranks and order statistics against NumPy, with ties and with groups that are cut in ranges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators.ranks import average_ranks, percentiles


def averaged(x):
    order = np.argsort(x, kind="stable")
    ranks = np.empty(len(x))
    ranks[order] = np.arange(1, len(x) + 1)
    return np.array([ranks[x == v].mean() for v in x])


@pytest.mark.parametrize("range_rows", [500_000, 37])
def test_ranks_and_percentiles(spark, range_rows):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=500), "tied": np.where(rng.random(600) < 0.5, 0.0, rng.normal(size=600)), "few": rng.integers(0, 3, 300).astype(float), "one": np.ones(1)}
    rows = [(k, i, float(v), float(-v * v)) for k, x in groups.items() for i, v in enumerate(x)] + [("a", 999, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double")
    got = {(r["k"], r["i"]): (r["rx"], r["ry"]) for r in average_ranks(df, ["k"], {"x": "rx", "y": "ry"}, range_rows).collect()}
    expected = {(k, i): p for k, x in groups.items() for i, p in enumerate(zip(averaged(x), averaged(-x * x), strict=True))}
    assert got == expected
    for r in percentiles(df, ["k"], "x", {"p5": 0.05, "p50": 0.5, "p99": 0.99}).collect():
        assert [r["p5"], r["p50"], r["p99"]] == pytest.approx(np.percentile(groups[r["k"]], [5, 50, 99]))


def test_a_million_rows_half_of_them_tied(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("k"), "id", F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.col("id") - 500_000.0).alias("x"))
    ranks = average_ranks(df, ["k"], {"x": "r"}, range_rows=20_000)
    got = ranks.agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.max(F.when(F.col("x") == 0, F.col("r"))).alias("tie"), F.min(F.when(F.col("x") == 0, F.col("r"))).alias("tie_min"), F.max("r").alias("top")).first()
    assert (got["n"], got["s"], got["tie"], got["tie_min"], got["top"]) == (1_000_000, 500_000.5 * 1_000_000, 500_000.5, 500_000.5, 1_000_000)
    # the tied half isn't one task's: it is spread over the partitions
    parts = ranks.where("x = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(p["count"] for p in parts) < 400_000
