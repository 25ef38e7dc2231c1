"""Cases behind findings of the third round."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import asof, bars as bar_ops, indicators, learn, panel, pnl, ranks, stats, tiles
from marketspark.plans import load_all, queries_factors, queries_pnl, queries_risk, queries_stats
from marketspark.sources.tables import Tables


def test_equal_bids_are_taken_larger_size_first(spark):
    levels = spark.createDataFrame([(1, s, 10.0, z) for s in ("bid", "ask") for z in (2.0, 5.0)], "ts long, side string, px double, sz double")
    orders = spark.createDataFrame([("s", 1, "sell", 4.0, 10.0), ("b", 1, "buy", 4.0, 10.0)], "order_id string, ts long, side string, req double, mid double")
    got = {r.order_id: r.levels_used for r in asof.walk_book(orders, levels, ["ts"]).collect()}
    assert got == {"s": 1, "b": 2}


def test_a_mean_discount_at_the_limit_is_short_in_any_order(spark):
    discounts = [0.1, 0.01, 0.04, 0.05, 0.0, 0.1, 0.07, 0.03, 0.05, 0.05]
    rng = np.random.default_rng(0)
    rows = [("A", k, float(d), 1000.0) for k in range(200) for d in rng.permutation(discounts)]
    lineitem = spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_discount double, l_extendedprice double")
    tables = type("T", (), {"raw": lambda self, name: lineitem})()
    assert {r.side for r in queries_risk._positions(tables).collect()} == {"short"}


def test_correlations_of_constant_sides_are_null(spark):
    rows = [("a", i, float(i * i % 7), 5.0 if i < 5 else float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double, ref double")
    got = indicators.rolling_comovement(df, "ref", 4).orderBy("ts").collect()
    assert [r["corr"] for r in got[:5]] == [None] * 5
    assert got[-1]["corr"] is None and got[7]["corr"] == pytest.approx(np.corrcoef(np.diff([r[2] for r in rows])[3:7], np.diff([r[3] for r in rows])[3:7])[0, 1])
    flat = spark.createDataFrame([("m", i, float(i % 3)) for i in range(9)] + [("f", i, 1.0) for i in range(9)], "symbol string, ts long, ret double")
    assert panel.lead_lag(flat, "m", 2).collect()[0]["best_corr"] is None
    assert [r["ic"] for r in stats.ic_curve(df.withColumn("fwd_1", F.lit(1.0)), ["close"], [1]).collect()] == [None]


@pytest.mark.parametrize(("curve", "times"), [(queries_pnl.grid_curve, 4), (queries_stats.walk_forward_metrics, 3)])
def test_partitions_of_run_curves_grow_with_the_deals(spark, curve, times):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.__dict__["deal_count"] = 40_000_000
    plan = curve(t)._jdf.queryExecution().executedPlan().toString()
    # the ledger's exchange and that of bars with closes; no join of the two
    assert plan.count(f", {times * 100}), REPARTITION_BY_NUM") == 2, plan
    assert not [line for line in plan.splitlines() if "Join" in line and "exit_ts" in line]


#: Queries on the run curves of the parameter grid, by finding.
RUN_CURVES = [
    "agg_28_portfolio_curve",  # F17
    "agg_28_portfolio_metrics",  # F18
    "agg_29_blacklist",  # F19
    "agg_29_monthly_matrix",  # F20
    "pnl_05_parameter_sweep",  # F21
    "srt_02_best_per_symbol",  # F22
    "srt_02_best_runs",  # F23
    "prj_17_research_grade",  # F24
    "agg_29_validated_edge",  # F25
]


@pytest.mark.parametrize("name", RUN_CURVES)
def test_queries_on_run_curves_hold_no_more_rows_a_task(spark, name):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.__dict__["deal_count"] = 40_000_000
    plan = load_all()[name].plan(t)._jdf.queryExecution().executedPlan().toString()
    # bars by symbol, then runs: all that tasks sort comes from exchanges that grow with the deals, none is made again behind them
    runs = re.findall(r"Exchange hashpartitioning\(strategy#\d+, symbol#\d+, (\d+)\), (\w+)", plan)
    assert len(runs) >= 2 and set(runs) == {("400", "REPARTITION_BY_NUM")}, plan
    assert set(re.findall(r"Exchange hashpartitioning\(symbol#\d+, (\d+)\), REPARTITION_BY_NUM", plan)) == {"100"}
    assert not re.search(r"Exchange hashpartitioning\([^)]*_run#", plan)


def test_two_closes_at_one_bar_and_a_ruin(spark):
    bars = spark.createDataFrame([(s, i, 1.0) for s in "ab" for i in range(4)], "symbol string, ts long, close double")
    trades = spark.createDataFrame([("a", 1, 1.5), ("a", 3, 2.0), ("a", 3, 0.5), ("b", 2, 0.0)], "symbol string, exit_ts long, multiplier double")
    got = {(r.symbol, r.ts): (r.equity, r.ret) for r in pnl.equity_on_bars(bars, trades, initial=100.0, parts=3).collect()}
    assert [got["a", i][0] for i in range(4)] == pytest.approx([100, 150, 150, 150]) and [got["a", i][1] for i in range(4)] == pytest.approx([0, 0.5, 0, 0])
    assert [got["b", i] for i in range(4)] == [(100, 0), (100, 0), (0, -1), (0, 0)]


@pytest.mark.parametrize("blocks", [1, 2, 3, 4])
@pytest.mark.parametrize("limit", [panel.BROADCAST_BYTES, 0])
def test_correlations_by_packed_blocks(spark, monkeypatch, blocks, limit):
    monkeypatch.setattr(panel, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 11))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 1.0
    rows = [(t, f"s{k}", float(x[t, k])) for t in range(30) for k in range(11) if not np.isnan(x[t, k])]
    df = spark.createDataFrame(rows, "ts long, symbol string, ret double")

    def corr(i, j):
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        return 0.0 if 4 in (i, j) else np.corrcoef(x[ok, i], x[ok, j])[0, 1]

    pairs = panel.correlations(df, blocks=blocks)
    got = {(r.a, r.b): r["corr"] for r in pairs.collect()}
    want = {tuple(sorted((f"s{i}", f"s{j}"))): corr(i, j) for i in range(11) for j in range(i)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    # pairs are whole where they are made: nothing of them is shuffled
    assert "Exchange hashpartitioning(a" not in pairs._jdf.queryExecution().executedPlan().toString()
    w = {f"s{k}": float(k - 5) for k in range(10)}
    totals = panel.weighted_correlations(df, spark.createDataFrame(list(w.items()), "symbol string, w double"), blocks=blocks)
    got = {r.symbol: r.total for r in totals.collect()}
    full = {k: sum(c * w.get(q if p == k else p, 0.0) for (p, q), c in want.items() if k in (p, q)) for k in (f"s{i}" for i in range(11))}
    assert np.allclose([got[k] for k in full], list(full.values()))
    cut = {(r.a, r.b): r["n"] for r in panel.pair_sums(df, blocks=blocks, chunk=F.col("ts") % 3).collect()}
    assert cut == {(r.a, r.b): r["n"] for r in panel.pair_sums(df, blocks=blocks).collect()}


def test_range_maps_of_long_groups_stay_out_of_exchanges(spark):
    rows = [(k, float(i * 37 % 101), float(i % 13)) for k in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = ranks._average_ranks(df, ["k"], {"x": "rx", "y": "ry"}, 50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(moved) == 2 and not any("_m0" in p or "_m1" in p for p in moved)
    rest = [n.split("#")[0] for n in out.columns]
    assert rest == ["k", "x", "y", "rx", "ry"]
    got = {(r.k, r.x, r.y): (r.rx, r.ry) for r in out.collect()}
    x = np.array([r[1] for r in rows[:400]])
    assert all(got["a", *r[1:]][0] == (x < r[1]).sum() + ((x == r[1]).sum() + 1) / 2 for r in rows[:400])
    joined = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in joined


def test_carried_bars_close_at_just_the_threshold(spark):
    df = spark.createDataFrame([("a", i, 0.1, 0.1, 0.1, 0.1, 1.0) for i in range(25)], "symbol string, ts long, open double, high double, low double, close double, volume double")
    got = {r.bar: r.volume for r in bar_ops.threshold_bars(df, 1.0, dollar=True, mode="carry").collect()}
    assert got == {0: 10.0, 1: 10.0, 2: 5.0}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


@pytest.mark.parametrize("wanted", [{"m": "macd", "s": "macd_signal", "h": "macd_histogram"}, {"d": ("dema", {"period": 4})}, {"t": ("tema", {"period": 4})}])
def test_recursions_on_recursions_take_one_exchange(spark, wanted):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(5)], "symbol string, ts long, close double")
    assert exchanges(indicators.add(df, wanted)) == 1


def test_library_set_takes_one_exchange(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, ts long, open double, high double, low double, close double, volume double")
    assert exchanges(indicators.library_set(df)) == 1


def test_chained_scans_equal_separate_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, None if k == "c" and i < 3 or k == "d" and i == 20 else float(v)) for k in "abcd" for i, v in enumerate(rng.normal(100, 5, 3 if k == "b" else 40))]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        ax = indicators.Axis()
        e1 = indicators._ema_of(df, ax, "e1", F.col("close"), 5)
        apart = indicators._ema_of(e1, ax, "e2", F.col("e1"), 4)
        once = indicators._emas_of(df, ax, {"e1": (F.col("close"), 5)}, [indicators._then_ema("e2", ["e1"], indicators._itself, 4)])
        want = {(r.symbol, r.ts): (r.e1, r.e2) for r in apart.collect()}
        got = {(r.symbol, r.ts): (r.e1, r.e2) for r in once.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and sum(v[1] is not None for v in got.values()) > 60


@pytest.mark.parametrize("limit", [panel.CHUNK_TIMES, 5])
def test_covariance_tiles_are_the_pairs_covariances(spark, monkeypatch, limit):
    monkeypatch.setattr(panel, "CHUNK_TIMES", limit)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 17))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[1:, 3] = np.nan
    x[0, 3] = 0.5
    df = spark.createDataFrame([(t, f"s{k:02d}", float(x[t, k])) for t in range(30) for k in range(17) if not np.isnan(x[t, k])], "ts long, symbol string, ret double")
    matrix, names, sizes = panel.kelly_system(df, fraction=2.0, tile=5)
    at = {r.symbol: (r.block, r.place, r.v) for r in names.collect()}
    assert sum(sizes.values()) == 17 and all(v[2] == pytest.approx(2 * np.nanmean(x[:, int(s[1:])])) for s, v in at.items())
    got = {(r.i, r.j): np.frombuffer(r.x).reshape(sizes[r.i], sizes[r.j]) for r in matrix.collect()}
    m = panel.moments(df)
    want = {(r.a, r.b): r["cov"] or 0.0 for r in panel.full_covariance(df, m).collect()}
    full = np.zeros((17, 17))
    for a, (i, p, _) in at.items():
        for b, (j, q, _) in at.items():
            full[int(a[1:]), int(b[1:])] = value = got[i, j][p, q] if i >= j else got[j, i][q, p]
            assert value == pytest.approx(want.get((min(a, b), max(a, b)), 0.0) + (1e-8 if a == b else 0.0), abs=1e-12)
    w = spark.createDataFrame([(s, float(k)) for k, s in enumerate(sorted(at))], "symbol string, w double")
    assert [r.y for r in tiles.product(matrix, names, sizes, w).orderBy("symbol").collect()] == pytest.approx(full @ np.arange(17.0))


def test_kelly_makes_no_row_of_a_pair(spark, monkeypatch):
    monkeypatch.setattr(panel, "correlations", None)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(t, s, float(v)) for t in range(9) for s, v in zip("abc", rng.normal(size=3))], "ts long, symbol string, ret double")
    assert panel.kelly_weights(df).count() == 3


def test_estimates_stay_short_however_many_blocks(spark):
    cov = spark.createDataFrame([(f"s{k:02d}", f"s{k:02d}", 2.0) for k in range(24)], "a string, b string, cov double")
    vector = cov.select(F.col("a").alias("symbol"), F.lit(4.0).alias("v"))
    w = tiles.solve(cov, vector, ridge=0.0, tile=4)
    assert w._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**60
    assert [r.w for r in w.collect()] == [2.0] * 24


@pytest.mark.parametrize("cells", [stats.CHUNK_CELLS, 300])
def test_resampling_sums_up_where_it_draws(spark, monkeypatch, cells):
    monkeypatch.setattr(stats, "CHUNK_CELLS", cells)  # 300: a series of 12 trades makes its 60 draws in three chunks
    rng = np.random.default_rng(4)
    rows = [(s, i, float(x)) for s, n in (("a", 12), ("b", 3)) for i, x in enumerate(rng.normal(1, 5, n))]
    trades = spark.createDataFrame(rows, "symbol string, entry_ts long, pnl_pct double")
    paths, flips = stats.trade_bootstrap(trades, 52.0, times=60), stats.sign_flip_test(trades, times=60)
    # no draw is a row
    assert all("draw#" not in df._jdf.queryExecution().executedPlan().toString() for df in (paths, flips))
    boot, flip = {r.symbol: r for r in paths.collect()}, {r.symbol: r for r in flips.collect()}
    for s in "ab":
        x = np.array([r[2] for r in rows if r[0] == s])
        made = min(60, cells // len(x))
        finals, worst, totals = [], [], []
        for chunk, at in enumerate(range(0, 60, made)):
            draws = min(made, 60 - at)
            path = np.cumprod(1 + x[np.random.default_rng([42, chunk]).integers(0, len(x), (len(x), draws), dtype=np.int32)] / 100, axis=0)
            finals += ((path[-1] - 1) * 100).tolist()
            worst += (((path / np.maximum.accumulate(path, axis=0)).min(axis=0) - 1) * 100).tolist()
            totals += (np.abs(x) * np.random.default_rng([42, chunk]).choice([-1.0, 1.0], (draws, len(x)))).tolist()
        assert np.allclose([boot[s].p5, boot[s].p50, boot[s].dd_p95], [*np.percentile(finals, [5, 50]), np.percentile(worst, 95)])
        assert boot[s].prob_profit == pytest.approx(100 * np.mean(np.array(finals) > 0))
        flipped = np.array(totals)
        assert flip[s].n == len(x) and flip[s].p_value == (1.0 if len(x) < 5 else np.mean(flipped.sum(axis=1) >= x.sum() - 1e-9))
        assert flip[s].real_sharpe == pytest.approx(x.mean() / x.std(ddof=1) * 252**0.5)
        assert flip[s].median_random_sharpe == pytest.approx(np.median(flipped.mean(axis=1) / flipped.std(axis=1, ddof=1) * 252**0.5))


def test_entry_features_are_not_shuffled(spark):
    plan = queries_factors._entries(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    # all recursions in one pass, nothing behind it but a filter
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert all("supertrend" not in line for line in plan.splitlines() if "Exchange" in line)
    rng = np.random.default_rng(6)
    rows = []
    for k, n in (("a", 90), ("b", 30), ("c", 3)):
        close = 100 + rng.normal(0, 3, n).cumsum()
        rows += [(k, i, float(c), float(c + rng.random()), float(c - rng.random()), float(c), float(rng.integers(1, 9))) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")
    trades = spark.createDataFrame([("a", 5, 1.0), ("a", 80, -1.0), ("b", 29, 2.0), ("b", 77, 9.0), ("d", 1, 1.0)], "symbol string, entry_ts long, pnl double")
    got = {(r.symbol, r.entry_ts): r for r in learn.entries(bars, trades, parts=3).collect()}
    assert {k: r.pnl for k, r in got.items()} == {("a", 5): 1.0, ("a", 80): -1.0, ("b", 29): 2.0}
    apart = bars
    for out, want in learn.ENTRY_INDICATORS.items():
        apart = indicators.add(apart, {out: want})
    want = {(r.symbol, r.ts): r for r in apart.collect()}
    assert all((got[k][c] or None) == (want[k][c] or None) for k in got for c in learn.ENTRY_INDICATORS)


def test_regimes_at_entry_take_one_exchange(spark):
    rng = np.random.default_rng(2)
    close = {"a": 100 * np.exp(rng.normal(0, 0.03, 120).cumsum()), "b": 100 * np.exp(rng.normal(0, 0.03, 99).cumsum())}
    bars = spark.createDataFrame([(s, 10 * i, float(c)) for s, v in close.items() for i, c in enumerate(v)], "symbol string, ts long, close double")
    entered = [5, 10 * 29, 10 * 30, 10 * 30, 441, 449, 450, 800, 10 * 119, 10 * 119 + 1]
    trades = spark.createDataFrame([(s, t, float(i - 4), float(i)) for s in "ab" for i, t in enumerate(entered)], "symbol string, entry_ts long, pnl double, pnl_pct double")
    out = pnl.by_regime(trades, bars, parts=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(") == 1 and ", 3), REPARTITION_BY_NUM" in plan
    want = {}
    for i, t in enumerate(entered):
        at = -(-t // 10)
        if 30 <= at < 120:
            move = close["a"][at] / close["a"][at - 30] - 1
            want.setdefault("bull" if move > 0.05 else "bear" if move < -0.05 else "sideways", []).append(i)
    got = {r.regime: r for r in out.collect()}
    assert {r.symbol for r in got.values()} == {"a"} and {k: (r.trades, r.total_pnl_pct) for k, r in got.items()} == {k: (len(v), sum(v)) for k, v in want.items()}


def test_booster_takes_few_partitions(spark, monkeypatch):
    met = []

    class Booster:
        def __init__(self, **options):
            pass

        def fit(self, data):
            met.append((data.rdd.getNumPartitions(), data.count()))
            raise InterruptedError

    monkeypatch.setattr(learn, "GBTClassifier", Booster)
    trades = spark.range(0, 120, 1, 60).selectExpr("cast(id as double) as x", "cast(id % 3 as double) - 1 as pnl")
    with pytest.raises(InterruptedError):
        learn.feature_importance(trades, ["x"])
    assert met == [(spark.sparkContext.defaultParallelism, 120)]


def test_huber_reads_its_rows_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries_factors.regress, "written", lambda df, keep=queries_factors.regress.written: made.append(df) or keep(df))
    df = spark.createDataFrame([("a", i, float(i * i % 7), float(i % 5)) for i in range(30)], "symbol string, ts long, y double, x double")
    fit = queries_factors.regress.huber_newey_west(df, "y", ["x"], keys=["symbol"])
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "FileScan parquet" in plan and not re.search(r"ExistingRDD\[symbol#\d+,ts#|LocalTableScan", plan)
    assert fit.count() == 1
