"""A cross-section of the registered queries against their DuckDB twins on the smallest tables. All of them:
``python tests/oracle_check.py``."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle_check import compare, connect  # noqa: E402

from marketspark.plans import load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "agg_01_bars_from_fills",
    "agg_03_volume_bars_reset",
    "agg_05_bars_from_books",
    "win_06_ema",
    "win_18_supertrend",
    "join_05_asof",
    "pnl_03_stop_loss",
    "agg_16_correlations",
    "sta_07_purged_kfold",
    "str_01_trade_tape_stream",
    "src_05_parse_fill_lines",
]


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_twin(spark, con, name):
    status, detail, _, rows = compare(spark, con, load_all()[name], SF)
    assert status == "ok" and rows > 0, detail


def test_entry_points():
    import __spark_entry__ as entry

    queries, twins = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(twins) <= set(queries)
    assert entry.FLAGSHIP in queries
