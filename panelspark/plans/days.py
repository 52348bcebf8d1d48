"""Days and instants come out of the queries as text, in either engine; here the columns that the SQL has to turn."""

from __future__ import annotations

_DAYS = {
    "date": """ohlc_daily returns_panel equity_drawdown equity_base_100 feat_cumulative feat_rolling_5 feat_rolling_21
        feat_rolling_63 feat_rolling_maxdd feat_rolling_variants feat_market_regime technicals market_trend
        expanding_quantiles rank_cross_section calendar_densify activity_gaps alive_mask fill_and_interpolate
        regime_smoothed rolling_vs_market winsorize_scale activity_filter universe_eligibility leadership_rotation
        positions_interval benchmark_weights benchmark_turnover benchmark_concentration benchmark_daily_returns
        rebalance_schedule_5d rebalance_schedule_21d rebalance_schedule_63d holdings_cumulative gips_cashflow dietz_daily
        recon_volume recon_value recon_equal recon_invvol family_aggregates universe_features rolling_corr_pair
        mean_rolling_corr regime_heuristic regime_fuzzy factor_zscore select_topn select_percentile alloc_equal
        alloc_invvol alloc_momentum constraints_step cost_model backtest_next_day backtest_same_day calendar_sets
        observation_matrix stitched_average weighted_index vol_target vol_target_smoothed class_indicators
        index_regime_rules transitions_dataset open_trades_return cash_flow_scale horizon_consistency constraint_violations""",
    "day_close": "rolling_trades_63d",
    "day_close day_open": "trades_clean",
    "death_date": "trim_dead_tail",
    "end start": "full_metrics",
    "first last": "phase_summary twr_subperiods regime_periods temporal_split",
    "month": "family_month_crosstab monthly_trade_metrics monthly_cashflows dietz_linked_monthly monthly_selection monthly_regimes",
    "period": "monthly_compound",
    "period_end period_start": "audit_periods split_overlap",
    "recovered trough": "recovery_days",
    "test_end test_start train_end train_start": "walk_forward_folds walk_forward_expanding",
    "week_end": "busiest_week",
}
_INSTANTS = {"bin": "resample_4h", "first last": "source_inspect"}


def as_text(name: str, sql: str) -> str:
    """The SQL with its days as yyyy-MM-dd and its instants as yyyy-MM-dd HH:mm:ss.SSSSSS."""
    casts = []
    for table, form in ((_DAYS, "strftime(CAST({0} AS DATE), '%Y-%m-%d')"), (_INSTANTS, "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')")):
        for columns, names in table.items():
            if name in names.split():
                casts += [form.format(f'"{c}"') + f' AS "{c}"' for c in columns.split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
