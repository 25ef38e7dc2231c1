"""Symbol names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tickers of traditional markets, which carry a venue prefix.
TRADFI = (
    "CL GOLD SILVER COPPER NATGAS BRENTOIL PLATINUM PALLADIUM URANIUM ALUMINIUM CORN WHEAT TTF DRAM EUR JPY KRW DXY VIX VOL H100 SP500"
).split()
PREFIX = "xyz:"


def normalise(pair: Column) -> Column:
    """Strip the perpetual suffix, upper-case, prefix traditional tickers."""
    bare = F.trim(F.regexp_replace(pair, "-PERP|-perp", ""))
    upper = F.upper(bare)
    return F.when(upper.isin(TRADFI), F.concat(F.lit(PREFIX), upper)).when(bare.startswith(PREFIX), F.concat(F.lit(PREFIX), F.upper(F.substring(bare, 5, 100)))).otherwise(upper)


def normalise_spot(coin: Column) -> Column:
    upper = F.upper(F.trim(coin))
    return F.when(upper.contains("/"), upper).otherwise(F.concat(upper, F.lit("/USDC")))


def market_of(coin: Column) -> Column:
    return F.when(coin.contains("/"), "spot").otherwise("perp")


def to_path(coin: Column) -> Column:
    return F.when(coin.contains("/"), F.concat(F.lit("spot-"), F.replace(coin, F.lit("/"), F.lit("-")))).otherwise(F.replace(coin, F.lit(":"), F.lit("-")))


def from_path(name: Column) -> Column:
    parts = F.split(F.substring(name, 6, 200), "-")
    spot = F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(name)
    return F.when(name.startswith("spot-"), spot).when(name.startswith("xyz-"), F.concat(F.lit(PREFIX), F.substring(name, 5, 200))).otherwise(name)
