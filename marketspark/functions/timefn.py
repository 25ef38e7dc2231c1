"""Interval arithmetic and duration strings. Times are epoch milliseconds (BIGINT)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per unit, and the Monday alignment of weeks (1970-01-01 is a Thursday).
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
WEEK_OFFSET_MS = 4 * 86_400_000
HOUR_MS = UNIT_MS["h"]
DAY_MS = UNIT_MS["d"]
# Weeks and months per year differ between statistics and trade simulation.
TRADING_PERIODS = {"1w": 52.0, "1M": 12.0}


def interval_ms(tf: str) -> int:
    found = re.fullmatch(r"(\d+)([smhdw])", tf)
    if not found or int(found[1]) == 0:
        raise ValueError(f"not an interval: {tf!r}; expected a count and one of s, m, h, d, w")
    return int(found[1]) * UNIT_MS[found[2]]


def interval_offset(tf: str) -> int:
    return WEEK_OFFSET_MS if tf.endswith("w") else 0


def bucket(ts: str | Column, tf: str) -> Column:
    """Start of the left-closed bucket that holds ``ts``; integer arithmetic throughout."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c - F.pmod(c - F.lit(interval_offset(tf)), F.lit(interval_ms(tf)))


def periods_per_year(tf: str, trading: bool = False) -> float:
    """Periods in a 365-day year; ``trading`` uses the rounded week and month of the simulator,
    where an unknown interval counts as hourly."""
    if trading and tf in TRADING_PERIODS:
        return TRADING_PERIODS[tf]
    try:
        return 365 * DAY_MS / interval_ms(tf)
    except ValueError:
        if trading:
            return 365 * DAY_MS / HOUR_MS
        raise


def parse_bar_freq(freq: str) -> tuple[str, float | str]:
    """``"4h"`` → ("time", "4h"); ``"volume:100"`` and ``"dollar:1e6"`` → (kind, threshold)."""
    kind, sep, size = freq.partition(":")
    if not sep:
        interval_ms(freq)
        return "time", freq
    if kind not in ("volume", "dollar") or float(size) <= 0:
        raise ValueError(f"not a bar frequency: {freq!r}")
    return kind, float(size)


def parse_walk_forward(config: str) -> tuple[int, int]:
    """``"3m/1m"`` → months of training and of testing."""
    found = re.fullmatch(r"(\d+)m/(\d+)m", config.strip())
    if not found:
        raise ValueError(f"not a walk-forward setting: {config!r}; expected e.g. 3m/1m")
    return int(found[1]), int(found[2])


def epoch_ms(value: str | int) -> int:
    """ISO date or time (naive = UTC) or epoch milliseconds, as epoch milliseconds."""
    from datetime import datetime, timezone

    if isinstance(value, int):
        return value
    parsed = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if parsed.tzinfo is None:
        parsed = parsed.replace(tzinfo=timezone.utc)
    return int(parsed.timestamp() * 1000)


def duration_seconds(text: str) -> float:
    """``"90s"``, ``"15m"``, ``"4h"``, ``"2d"`` as seconds."""
    return interval_ms(text) / 1000
