"""A cross-section of the registered queries against their SQL on the smallest data; the driver runs all of them on more."""

import pytest

import __spark_entry__ as entry
from compare import assert_same, connect

NAMES = [
    "p1_found", "p2_found", "p2_attributes", "p3_found", "p3_rolling", "p5_found", "p6_found", "p7_found", "fac_ret_1m", "fac_abnormal_turnover", "fac_atr_14", "fac_kurtosis_20", "fac_streak", "fac_f_score",
    "op_a_rank", "op_a_std", "op_b_ts_ema_decay", "op_b_nested", "op_c_lines", "op_c_ts_rank", "rel_asof_backward", "rel_asof_strict_lifetime", "rel_ttm", "rel_event_window", "rel_weekly_bars", "stat_daily_ic",
    "stat_half_life", "port_quantile_returns", "port_correlation_matrix", "inf_holm", "inf_hac", "inf_performance", "mod_neutralised", "mod_nearest", "sim_target_weights", "sim_ledger", "sig_macd", "sig_kdj", "strm_tumbling", "strm_interval_maps", "io_json",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    assert_same(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["trade_date", "n", "pearson", "spearman"] and df.count() > 0
