"""They must equal the published behaviour for results to agree."""

# --- fixed values: severities and ledger states
MATERIAL = "MATERIAL"
MINOR = "MINOR"
AMBIGUOUS = "AMBIGUOUS"
EXPECTED = "EXPECTED"
OPEN = "OPEN"
RESOLVED = "RESOLVED"
EXCLUDED = "EXCLUDED"

# --- fixed values: markets with a registered trading calendar
MARKETS = {"US_EQUITY": "XNYS"}
EXCHANGE_TZ = "America/New_York"

# --- fixed values: checks the discovery gate requires
REQUIRED_CHECKS = (
    "calendar",
    "sessions",
    "minute_bars",
    "duplicates",
    "timestamp_gaps",
    "stale",
    "news_timestamps",
    "corporate_actions",
)

# --- fixed values: split ratios regarded as common
COMMON_RATIOS = (2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 50, 100)

# --- fixed values: event kinds the experiment log accepts
EVENT_KINDS = (
    "GENESIS",
    "DATASET",
    "PREREG",
    "EXPERIMENT",
    "EVAL",
    "LEAKAGE_TEST",
    "CONTAMINATION",
    "CLASSIFICATION",
    "REPLICATION",
    "PAPER",
    "SELFTEST",
    "NOTE",
    "FINAL_TEST",
    "VAULT_SEAL",
    "DATA_GAP",
    "INTEGRITY_REPORT",
)
GENESIS_PREV = "0" * 64

# --- fixed values: order in which the life-cycle instants of a signal must occur
SIGNAL_CHAIN = (
    "event_ts",
    "publication_ts",
    "vendor_receipt_ts",
    "system_receipt_ts",
    "signal_ts",
    "order_ts",
    "execution_ts",
)

# --- fixed values: unscheduled full-day closures of the New York exchange since 1985
ADHOC_CLOSURES = (
    "1985-09-27",
    "1994-04-27",
    "2001-09-11",
    "2001-09-12",
    "2001-09-13",
    "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29",
    "2012-10-30",
    "2018-12-05",
    "2025-01-09",
)
# --- fixed values: unscheduled 13:00 closes
ADHOC_EARLY_CLOSES = ("1997-12-26", "1999-12-31", "2003-12-26", "2013-07-03")

EULER_GAMMA = 0.5772156649015329

# --- fixed values: execution cost model, one row per regime
BASELINE_EXEC = {
    "scenario": "baseline",
    "spread_mult": 1.0,
    "default_spread_bps": 4.0,
    "slip_bps": 1.0,
    "comm_bps": 0.5,
    "open_penalty_bps": 2.0,
    "impact_coef": 0.10,
    "latency_bars": 0,
    "borrow_bps_annual": 50.0,
    "financing_bps_annual": 400.0,
    "delist_haircut": 0.0,
    "capital": 100_000.0,
    "max_weight": 0.10,
    "max_gross": 2.0,
    "mode": "open_to_open",
    "periods_per_year": 252,
}
OPTIMISTIC_EXEC = {
    **BASELINE_EXEC,
    "scenario": "optimistic",
    "spread_mult": 0.6,
    "slip_bps": 0.3,
    "comm_bps": 0.2,
    "open_penalty_bps": 0.5,
    "impact_coef": 0.05,
    "borrow_bps_annual": 30.0,
}
PESSIMISTIC_EXEC = {
    **BASELINE_EXEC,
    "scenario": "pessimistic",
    "spread_mult": 2.0,
    "slip_bps": 3.0,
    "comm_bps": 1.0,
    "open_penalty_bps": 5.0,
    "impact_coef": 0.25,
    "latency_bars": 1,
    "borrow_bps_annual": 150.0,
    "delist_haircut": 0.10,
}
REGIMES = (OPTIMISTIC_EXEC, BASELINE_EXEC, PESSIMISTIC_EXEC)

# --- fixed values: gate thresholds
THRESHOLDS = {
    "version": "1.0",
    "min_dsr": 0.95,
    "max_perm_p": 0.05,
    "max_spa_p": 0.10,
    "max_pbo": 0.50,
    "min_baseline_net_sharpe": 0.5,
    "min_gross_to_cost": 2.0,
    "min_neighbor_pos_frac": 0.70,
    "min_neighbor_median_ratio": 0.50,
    "max_top5_share": 0.50,
    "min_subperiod_pos_frac": 0.60,
    "n_subperiods": 5,
    "max_plausible_sharpe": 5.0,
    "min_power_for_claim": 0.50,
    "min_alpha_t": 2.0,
    "oos_max_p": 0.10,
    "oos_min_ratio": 0.25,
    "oos_min_sharpe": 0.3,
    "max_paper_discrepancy": 0.5,
    "min_paper_days": 60,
    "n_perm": 1000,
    "n_boot": 1000,
    "seed": 12345,
}

# --- fixed values: verdicts, and the gates a small sample alone can fail
REJECTED = "REJECTED"
INTERESTING = "INTERESTING BUT UNPROVEN"
ROBUST_DEV = "ROBUST RESEARCH CANDIDATE (dev-only; locked OOS pending)"
ROBUST = "ROBUST RESEARCH CANDIDATE"
PAPER_VALIDATED = "PAPER-VALIDATED CANDIDATE"
LIVE = "LIVE CANDIDATE"
SIGNIFICANCE_GATES = (
    "deflated_sharpe",
    "placebo_timing_permutation",
    "factor_alpha",
    "trade_concentration",
    "subperiod_stability",
)
