"""A user's own strategy and indicator, registered and run like the built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from marketspark.functions.strategies import Param, Strategy, strategy, targets
from marketspark.operators import indicators as I
from marketspark.operators import pnl
from marketspark.operators.series import full_frame
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import full, lag, over, with_
from marketspark.sources.tables import Tables


@strategy("buy_dips")
class BuyDips(Strategy):
    """Long from a close well below its mean until one above it."""

    params = {"period": Param(20, 2, 500, "bars of the mean"), "depth": Param(0.02, 0.0, 0.5, "how far below")}

    def indicators(self) -> dict:
        return {"mean": ("sma", {"period": self.values["period"]})}

    def on_bar(self, bar: Row, state: dict) -> float:
        if bar["mean"] is not None:
            if bar["close"] < (1 - self.values["depth"]) * bar["mean"]:
                state["held"] = 1.0
            elif bar["close"] > bar["mean"]:
                state["held"] = 0.0
        return state.get("held", 0.0)


@I.indicator("user", period=10)
def path_efficiency(df, ax, out, period):
    """Net move of the last bars over the sum of their moves."""
    w = ax.w
    df = df.withColumn("_move", F.abs(F.col("close") - F.lag("close").over(w)))
    path = full_frame(F.sum("_move"), F.col("_move"), w, period)
    return df.withColumn(out, F.abs(F.col("close") - F.lag("close", period).over(w)) / F.nullif(path, F.lit(0.0))).drop("_move")


_DIPS = f"SELECT *, CASE WHEN close < 0.98 * mean THEN 1 WHEN close > mean THEN 0 END AS says FROM (SELECT *, {full('avg(close)', 20)} AS mean FROM bn)"


@query("udf_02_user_strategy", "symbol ts", "target", with_("bn", f"SELECT symbol, ts, coalesce(last_value(says IGNORE NULLS) {over()}, 0) AS target FROM d", d=_DIPS))
def _(t: Tables) -> DataFrame:
    return targets(t.bars.select("symbol", "ts", "close"), "buy_dips")


@query(
    "udf_02_user_strategy_trades",
    "symbol entry_ts",
    "entry_price",
    with_(
        "bn",
        "SELECT symbol, ts AS entry_ts, close AS entry_price FROM h WHERE target = 1 AND coalesce(before, 0) = 0",
        d=_DIPS,
        p=f"SELECT *, coalesce(last_value(says IGNORE NULLS) {over()}, 0) AS target FROM d",
        h=f"SELECT *, {lag('target')} AS before FROM p",
    ),
)
def _(t: Tables) -> DataFrame:
    return pnl.ledger(targets(t.bars, "buy_dips"), pnl.Costs(0.0, 0.0))


@query(
    "udf_03_user_indicator",
    "symbol ts",
    "efficiency",
    with_("bn", f"SELECT symbol, ts, CASE WHEN rn > 10 THEN abs(close - {lag('close', 10)}) / nullif(sum(m) {over(10)}, 0) END AS efficiency FROM (SELECT *, abs(close - {lag('close')}) AS m FROM bn)"),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return I.add(t.bars, {"efficiency": "path_efficiency"})
