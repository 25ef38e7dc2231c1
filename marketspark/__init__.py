"""Market analytics on Spark: bars, indicators, signals, trade ledgers, statistics and risk as DataFrame jobs."""
