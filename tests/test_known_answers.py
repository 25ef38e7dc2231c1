"""Hand-computed answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.functions import signals
from marketspark.functions.timefn import parse_bar_freq, parse_walk_forward, periods_per_year
from marketspark.operators import asof, bars, cost, panel, pnl, regress, stats

FILLS = [
    (1700000101000, 50000.0, 1.0, True, True, True, 0.0, 1.7),
    (1700000101000, 50000.0, 1.0, True, False, False, 0.0, -0.85),
    (1700000220000, 50100.0, 0.5, False, False, True, -50.0, 0.85),
    (1700000220000, 50100.0, 0.5, False, True, False, 50.0, -0.43),
    (1700000405000, 49900.0, 2.0, True, False, True, 0.0, 1.7),
    (1700000405000, 49900.0, 2.0, True, True, False, 0.0, -0.85),
]


def test_fills_to_bars(spark):
    rows = [("X", *f, i) for i, f in enumerate(FILLS)]
    df = spark.createDataFrame(rows, "symbol string, ts long, price double, size double, is_open boolean, is_long boolean, crossed boolean, closed_pnl double, fee double, seq long")
    a, b = bars.bars_from_fills(df, "5m").orderBy("ts").collect()
    assert (a.ts, a.open, a.high, a.low, a.close, a.volume, a.num_trades) == (1700000100000, 50000, 50100, 50000, 50100, 1.5, 2)
    assert (a.buy_volume, a.sell_volume, a.opens_long, a.closes_short, a.net_flow, a.total_pnl) == (1.5, 0, 1.0, 0.5, 1.5, -50)
    assert a.total_fees == pytest.approx(2.55)
    assert (b.ts, b.open, b.volume, b.sell_volume, b.opens_short, b.net_flow) == (1700000400000, 49900, 2, 2, 2, -2)


def test_markouts(spark):
    prices = spark.createDataFrame([("X", t * 1000, p, 0) for t, p in [(0, 100.0), (1, 100.1), (10, 100.5), (60, 101.0), (300, 103.0)]], "symbol string, ts long, price double, seq long")
    fill = spark.createDataFrame([("X", 0, 100.0, "B")], "symbol string, ts long, price double, side string")
    got = {r.horizon_s: r.markout_bps for r in asof.markouts(fill, prices, (1, 10, 60, 300, 400)).collect()}
    assert [round(got[h], 6) for h in (1, 10, 60, 300)] == [10, 50, 100, 300] and got[400] is None


def test_ledger_multiplier(spark):
    rows = [("X", i * 3_600_000, p, p + 1, p - 1, t) for i, (p, t) in enumerate([(100.0, 0), (100.0, 1), (110.0, 1), (120.0, 0), (120.0, 0)])]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double, high double, low double, target int")
    t = pnl.ledger(df, pnl.Costs(fee=0.001, slippage=0.0, leverage=1.0, fraction=1.0)).first()
    assert (t.entry_price, t.exit_price, t.exit_reason, t.bars_held) == (100.0, 120.0, "signal", 2)
    assert t.multiplier == pytest.approx(1 - 0.001 + 0.2 - 1.2 * 0.001)


def test_signal_rules_on_single_rows(spark):
    state = spark.createDataFrame([(20.0, 6e-5, 4.0), (72.0, -2e-5, 0.5)], "rsi double, predicted_funding double, funding_zscore double").withColumn("symbol", F.lit("X"))
    got = signals.score_columns(state, ["rsi_extreme", "funding_extreme", "funding_zscore"]).orderBy("rsi").collect()
    assert [round(got[0][c], 6) for c in ("s_rsi_extreme", "s_funding_extreme", "s_funding_zscore")] == [0.2, -0.6, -1.0]
    assert [round(got[1][c], 6) for c in ("s_rsi_extreme", "s_funding_extreme", "s_funding_zscore")] == [-0.4, 0.3, 0.0]
    assert len(signals.SIGNALS) == 38


def test_overfilled_order_is_an_error(spark):
    orders = spark.createDataFrame([(1, "buy", 100.0, 1.0, 101.0)], "order_id int, side string, decision_price double, intended_size double, final_mid double")
    fills = spark.createDataFrame([(1, 100.5, 2.0, 0.1)], "order_id int, price double, size double, fee double")
    with pytest.raises(Exception, match="over-filled"):
        cost.implementation_shortfall(orders, fills).collect()


def test_newey_west_and_huber_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    y = 0.5 + x @ np.array([1.0, -2.0]) + rng.normal(size=150)
    df = spark.createDataFrame([("k", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(150)], "symbol string, ts long, y double, a double, b double")
    fit = regress.ols_newey_west(df, "y", ["a", "b"], keys=["symbol"]).first()
    big = np.column_stack([np.ones(150), x])
    beta = np.linalg.lstsq(big, y, rcond=None)[0]
    score = big * (y - big @ beta)[:, None]
    lag = int(math.floor(4 * 1.5 ** (2 / 9)))
    meat = score.T @ score
    for j in range(1, lag + 1):
        g = score[j:].T @ score[:-j]
        meat += (1 - j / (lag + 1)) * (g + g.T)
    inv = np.linalg.inv(big.T @ big)
    assert np.allclose(fit.coef, beta) and np.allclose(fit.se, np.sqrt(np.diag(inv @ meat @ inv)))
    robust = regress.huber_newey_west(df, "y", ["a", "b"], keys=["symbol"]).first()
    assert np.allclose(robust.coef, beta, atol=0.2)


def test_kelly_against_numpy(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0.001, 0.02, size=(60, 4))
    rows = [(t, f"s{k}", float(r[t, k])) for t in range(60) for k in range(4)]
    df = spark.createDataFrame(rows, "ts long, symbol string, ret double")
    got = {row.symbol: row.w for row in panel.kelly_weights(df, max_single=1e9, max_gross=1e9).collect()}
    want = 0.5 * np.linalg.solve(np.cov(r, rowvar=False) + 1e-8 * np.eye(4), r.mean(axis=0))
    assert np.allclose([got[f"s{k}"] for k in range(4)], want)


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rows = [(s, i, math.sin(i) / 50) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts long, ret double")
    runs = [sorted(map(tuple, stats.bootstrap_metrics(df.repartition(p), 52.0, times=20).collect())) for p in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 40


def test_small_helpers():
    assert parse_bar_freq("volume:100") == ("volume", 100.0) and parse_walk_forward("3m/1m") == (3, 1)
    assert periods_per_year("1h") == 8760 and periods_per_year("1w", trading=True) == 52.0
