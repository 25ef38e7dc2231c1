"""The sliced forms of the series primitives against the plain ones, with one hot series."""

import random

import pytest
from pyspark.sql import functions as F

from marketspark.operators import ranks
from marketspark.operators.asof import asof_join
from marketspark.operators.series import affine_scan, day_of, fill_forward, number_rows, running_sums, windowed

DAY = 86_400_000


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(1)
    rows = [("hot", i * DAY // 7, rng.random()) for i in range(300)] + [(f"s{k}", i * DAY, rng.random()) for k in range(5) for i in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts long, x double").repartition(7)


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sliced_equals_plain(ticks, parts):
    t = ticks.repartition(parts)
    assert _rows(number_rows(t, slice_by=day_of()).select("symbol", "ts", "rn")) == _rows(number_rows(t).select("symbol", "ts", "rn"))
    cols = ["symbol", "ts", "s"]
    assert _rows(running_sums(t, {"s": F.col("x")}, slice_by=day_of()).select(*cols)) == _rows(running_sums(t, {"s": F.col("x")}).select(*cols))
    gaps = {"s": F.when(F.col("x") > 0.8, F.col("x"))}
    plain = [tuple(r) for r in fill_forward(t, gaps).select(*cols).orderBy("symbol", "ts").collect()]
    assert [tuple(r) for r in fill_forward(t, gaps, slice_by=day_of()).select(*cols).orderBy("symbol", "ts").collect()] == plain


def test_blocked_windows_equal_plain(ticks):
    def build(df, w):
        return df.withColumn("m", F.avg("x").over(w.rowsBetween(-9, 0)))

    cols = ["symbol", "ts", "m"]
    blocked = windowed(ticks, build, reach=9, slice_by=day_of(), block_rows=32)
    assert _rows(blocked.select(*cols)) == _rows(windowed(ticks, build, reach=9).select(*cols))


def test_blocked_scan_equals_plain(ticks):
    i = F.col("x")
    coded = {"y": (F.lit(0.9), 0.1 * i)}
    first = number_rows(ticks, out="i")
    scans = {"y": (F.when(F.col("i") == 3, 0.0).when(F.col("i") > 3, 0.9), F.when(F.col("i") == 3, i).otherwise(0.1 * i))}
    plain = affine_scan(first, scans).select("symbol", "ts", "y").orderBy("symbol", "ts").collect()
    blocked = affine_scan(first, scans, slice_by=day_of(), block_rows=16).select("symbol", "ts", "y").orderBy("symbol", "ts").collect()
    assert len(plain) == len(blocked) == 400
    for a, b in zip(plain, blocked):
        assert (a.y is None) == (b.y is None) and (a.y is None or abs(a.y - b.y) < 1e-12)
    # a recursion that nothing starts stays NULL
    assert affine_scan(ticks, coded).where("y is not null").count() == 0


def test_asof_takes_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 3 * DAY), ("b", 1)], "symbol string, ts long")
    right = spark.createDataFrame([("a", 6, 1.0), ("a", 10, 2.0), ("c", 1, 9.0)], "symbol string, ts long, v double")
    got = {(r.symbol, r.ts): r.v for r in asof_join(left, right, ["v"]).collect()}
    assert got == {("a", 5): None, ("a", 10): 2.0, ("a", 3 * DAY): 2.0, ("b", 1): None}
    ahead = {(r.symbol, r.ts): r.v for r in asof_join(left, right, ["v"], direction="forward").collect()}
    assert ahead == {("a", 5): 1.0, ("a", 10): 2.0, ("a", 3 * DAY): None, ("b", 1): None}


def test_percentiles_and_ranks_exact_under_skew(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.concatenate([np.zeros(400), rng.normal(size=601), np.full(200, 0.5)])
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, x double")
    got = ranks.percentiles(df, ["k"], "x", {"p1": 0.01, "p37": 0.37, "p95": 0.95}).first()
    for name, q in (("p1", 1), ("p37", 37), ("p95", 95)):
        assert abs(got[name] - np.percentile(values, q)) < 1e-12
    order = np.sort(values)
    for r in ranks.average_ranks(df, ["k"], {"x": "rank"}).distinct().collect():
        low, high = np.searchsorted(order, r.x, "left") + 1, np.searchsorted(order, r.x, "right")
        assert r["rank"] == (low + high) / 2
