"""Normal distribution in column expressions against the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from marketspark.functions.probability import normal_cdf, normal_ppf, student_cdf


def test_normal_distribution(spark):
    zs = [-40.0, -9.0, -7.1, -7.0, -3.0, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.0, 8.5, 40.0]
    rows = spark.createDataFrame([(z,) for z in [*zs, None, float("nan")]], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        if r["z"] is None or math.isnan(r["z"]):
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-6, abs=1e-300)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-4, 0.02, 0.03, 0.5, 0.7, 0.975, 0.98, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", normal_ppf(F.col("p")).alias("z")).collect()
    for r in rows:
        assert (r["z"] is None) if r["p"] in (0.0, 1.0, None) else r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-9, abs=1e-12)


def test_student_distribution(spark):
    # quantiles of printed tables, and the closed forms for one and two degrees of freedom
    known = [(2.0, 10, 0.963306), (-2.0, 10, 0.036694), (0.0, 5, 0.5), (2.015048, 5, 0.95), (3.182446, 3, 0.975), (1.660234, 100, 0.95), (2.625891, 100, 0.995), (1.645464, 2500, 0.95), (1.646380, 999, 0.95)]
    known += [(t, 1, 0.5 + math.atan(t) / math.pi) for t in (-30.0, -1.0, 0.3, 7.0)] + [(t, 2, 0.5 + t / (2 * math.sqrt(2 + t * t))) for t in (-30.0, -1.0, 0.3, 7.0)]
    rows = spark.createDataFrame([*known, (None, 3, None), (1.0, None, None), (1.0, 0, None), (float("nan"), 3, None)], "t double, df long, want double")
    for r in rows.select("*", student_cdf(F.col("t"), F.col("df")).alias("got")).collect():
        assert r["got"] is None if r["want"] is None else r["got"] == pytest.approx(r["want"], abs=2e-6), r
