"""Parameters of the ledger operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values: defaults that results must agree on
    midnight_start: float = 22.0
    midnight_end: float = 6.0
    normal_start: float = 8.5
    normal_end: float = 18.5
    period_margin: int = 5
    zscore_group: int = 30
    zscore_least: int = 10
    zscore: float = 3.0
    round_digits: int = 2
    round_total: int = 3
    near_ratio: float = 0.90
    backdated_days: int = 30
    balance_tolerance: float = 0.01
    duplicate_days: int = 90
    duplicate_tolerance: float = 0.02
    duplicate_cap: float = 100_000.0
    reversal_days: int = 45
    burst_window: int = 14
    burst_least: int = 7
    group_least: int = 10
    group_days: int = 3
    group_excess: float = 3.0
    group_ratio: float = 2.0
    rolling_days: int = 7
    range_count: int = 5
    round_least: int = 100
    round_excess: float = 0.05
    concentration_z: float = 3.5
    concentration_docs: int = 10
    benford_mad: float = 0.012
    shift_activity: float = 0.5
    shift_shape: float = 0.3
    shift_top: float = 0.25
    dormant_days: int = 180
    rare_quantile: float = 0.10
    hours_sigma: float = 2.5
    hours_ratio: float = 0.1
    batch_share: float = 0.5
    batch_same_time: int = 50
    rrf_k: int = 60
    manual_sources: tuple[str, ...] = ("manual", "adjustment")
    automated_sources: tuple[str, ...] = ("automated", "recurring", "interface", "batch")
    revenue_prefixes: tuple[str, ...] = ("4",)
    expense_prefixes: tuple[str, ...] = ("5", "6")
    asset_prefixes: tuple[str, ...] = ("1",)
    suspense_prefixes: tuple[str, ...] = ("19", "29")
    suspense_words: tuple[str, ...] = ("suspense", "clearing", "가수금", "가지급")
    high_words: tuple[str, ...] = ("cancel", "reversal", "correction", "취소", "정정")
    medium_words: tuple[str, ...] = ("adjust", "settlement", "조정", "정산")
    fixed_holidays: tuple[tuple[int, int], ...] = ((1, 1), (3, 1), (5, 5), (6, 6), (8, 15), (10, 3), (10, 9), (12, 25))
    # fixed values: public holidays of Korea that move (by the lunar calendar), stand in for others, or were set once, by year
    moving_holidays: tuple[str, ...] = (
        "2022-01-31", "2022-02-01", "2022-02-02", "2022-03-09", "2022-05-08", "2022-06-01", "2022-09-09", "2022-09-10", "2022-09-11", "2022-09-12", "2022-10-10",
        "2023-01-21", "2023-01-22", "2023-01-23", "2023-01-24", "2023-05-27", "2023-05-29", "2023-09-28", "2023-09-29", "2023-09-30", "2023-10-02",
        "2024-02-09", "2024-02-10", "2024-02-11", "2024-02-12", "2024-04-10", "2024-05-06", "2024-05-15", "2024-09-16", "2024-09-17", "2024-09-18", "2024-10-01",
        "2025-01-27", "2025-01-28", "2025-01-29", "2025-01-30", "2025-03-03", "2025-05-06", "2025-06-03", "2025-10-05", "2025-10-06", "2025-10-07", "2025-10-08",
        "2026-02-16", "2026-02-17", "2026-02-18", "2026-03-02", "2026-05-24", "2026-05-25", "2026-06-03", "2026-08-17", "2026-09-24", "2026-09-25", "2026-09-26", "2026-10-05",
    )
    own_holidays: tuple[str, ...] = ()
    year_start: int = 1  # the month in which the fiscal year begins
    approval_ladder: tuple[float, ...] = (1_000_000.0, 10_000_000.0, 100_000_000.0, 500_000_000.0, 1_000_000_000.0)
    rounding: int = 6


DEFAULT = Settings()
