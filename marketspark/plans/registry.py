"""Registry of runnable queries: a Spark plan over ``Tables`` and, where SQL can say it, a DuckDB twin.

``keys`` are exact columns, ``vals`` are doubles that both sides round alike before comparison.
Rounding is done a little off the usual midpoint: short decimals (prices, fees) fall on midpoints
all the time, and there the two engines' ``round`` may go different ways.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    keys: tuple[str, ...]
    vals: tuple[str, ...]
    digits: int
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # times are epoch milliseconds and UTC; only this setting of the session is relied on
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = self.plan(Tables(spark, sf_dir))
        nudge = 0.137 * 10.0**-self.digits
        rounded = [(F.round(F.col(v) + F.lit(nudge), self.digits) + F.lit(0.0)).alias(v) for v in self.vals]
        return df.select(*self.keys, *rounded)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        nudge = f"CAST({0.137 * 10.0**-self.digits!r} AS DOUBLE)"
        cols = [*self.keys, *[f"round(CAST({v} AS DOUBLE) + {nudge}, {self.digits}) + CAST(0 AS DOUBLE) AS {v}" for v in self.vals]]
        return f"SELECT {', '.join(cols)} FROM ({self.sql}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, keys: str = "", vals: str = "", sql: str | None = None, digits: int = 6) -> Callable:
    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, plan, tuple(keys.split()), tuple(vals.split()), digits, sql)
        return plan

    return register
