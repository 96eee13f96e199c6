"""Business definitions of the loan book, kept in one immutable object.

Everything a risk team may want to vary (labels, thresholds, windows, minimum sample) is a field
here, so that a plan never carries a literal of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist


@dataclass(frozen=True)
class Definitions:
    # Labels of segments. `no_application` means the contract has no application row,
    # `missing` means the application exists but the attribute is NULL.
    no_application: str = "(unknown)"
    missing: str = "Unknown"
    small_channel_group: str = "Other"
    cohort_separator: str = " to "

    # Channels too small to be shown on their own.
    small_channels: tuple[str, ...] = ("Car dealer", "Channel of corporate sales")

    # Contract statuses.
    open_statuses: tuple[str, ...] = ("Active", "Demand", "Amortized debt")
    closed_status: str = "Completed"
    known_statuses: tuple[str, ...] = (
        "Active", "Demand", "Amortized debt", "Completed", "Signed", "Approved", "Sent proposal",
        "Refused", "Canceled", "Returned to the store", "XNA",
    )

    # Fixed values: "no value" codes of the raw tables.
    empty_day: int = 365243
    empty_text: str = "XNA"
    not_applicable_text: str = "XAP"

    # Days-past-due buckets (upper edges of all but the last) and debt groups.
    bucket_labels: tuple[str, ...] = ("B0 Current", "B1 1-30", "B2 31-60", "B3 61-90", "B4 90+")
    bucket_edges: tuple[int, ...] = (0, 30, 60, 90)
    exit_states: tuple[str, ...] = ("Closed", "Other", "Missing")
    past_due_days: int = 30
    severe_days: int = 90
    debt_group_edges: tuple[int, ...] = (9, 90, 180, 360)

    # Observation window, in relative months.
    window_start: int = -96
    last_month: int = -1
    cohort_width: int = 12
    max_mob: int = 36

    # First-payment default.
    grace_days: int = 30
    paid_tolerance: float = 0.95

    # Products and sources.
    products: tuple[str, ...] = ("Cash loans", "Consumer loans", "Revolving loans")
    base_product: str = "Cash loans"
    card_source: str = "credit_card"
    instalment_source: str = "pos_cash"

    # Reporting thresholds.
    min_n: int = 1000
    few_cases: int = 5
    thin_cases: int = 10
    report_mobs: tuple[int, ...] = (6, 12, 24)

    # Statistics.
    confidence: float = 0.95
    power: float = 0.80
    digits: int = 10

    @property
    def tail(self) -> float:
        return (1 - self.confidence) / 2

    @property
    def z(self) -> float:
        return NormalDist().inv_cdf(1 - self.tail)

    @property
    def z_power(self) -> float:
        return NormalDist().inv_cdf(self.power)

    @property
    def to_states(self) -> tuple[str, ...]:
        return self.bucket_labels + self.exit_states

    @property
    def closed_end_states(self) -> tuple[str, ...]:
        return ("closed", "closed_inferred")
