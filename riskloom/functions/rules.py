"""Business rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StatusBands:
    """First day past due of each portfolio status."""

    default_from: int
    high_from: int
    watch_from: int


# The marts and the Gold snapshot use different bands.
MART_BANDS = StatusBands(default_from=90, high_from=30, watch_from=1)
SNAPSHOT_BANDS = StatusBands(default_from=91, high_from=31, watch_from=6)

# Texts that count as a set suspicious flag.
TRUE_TOKENS = ("true", "1", "t", "yes")

# Display labels per code.
STATUS_LABELS = {
    "PERFORMING": "Performing",
    "WATCHLIST": "Watchlist",
    "HIGH_RISK": "High Risk",
    "DEFAULT_RISK": "Default Risk",
}
HEALTH_LABELS = {
    "HEALTHY": "Healthy",
    "PARTIALLY_BLOCKED": "Partially Blocked",
    "FULLY_BLOCKED": "Fully Blocked",
    "ALL_CLOSED": "All Closed",
}
AUDIT_LABELS = {"answered": "Answered", "rejected": "Blocked by Guardrails"}

CRITICAL_STATUSES = ("HIGH_RISK", "DEFAULT_RISK")
BLOCKED_HEALTH = ("FULLY_BLOCKED", "PARTIALLY_BLOCKED")


def portfolio_status(days_past_due: Column, bands: StatusBands = MART_BANDS) -> Column:
    """Credit status that follows from the worst whole number of days past due."""
    return (
        F.when(days_past_due >= bands.default_from, "DEFAULT_RISK")
        .when(days_past_due >= bands.high_from, "HIGH_RISK")
        .when(days_past_due >= bands.watch_from, "WATCHLIST")
        .otherwise("PERFORMING")
    )


def account_health(total: Column, active: Column, blocked: Column, closed: Column) -> Column:
    """Health status of a customer's set of accounts."""
    any_blocked = blocked > 0
    return (
        F.when(any_blocked, F.when(active == 0, "FULLY_BLOCKED").otherwise("PARTIALLY_BLOCKED"))
        .when(closed == total, "ALL_CLOSED")
        .otherwise("HEALTHY")
    )


def share_pct(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``; null when the whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def risk_rating(days_past_due: Column, internal_score: Column) -> Column:
    """Loan rating: the best grade whose delay limit, and score floor if it has one, is met."""
    # Fixed values: (grade, most days past due, lowest score).
    ladder = (("AA", 0, 750), ("A", 5, 680), ("B", 15, None), ("C", 30, None), ("D", 90, None))
    met = [
        F.when((days_past_due <= days) & (F.lit(True) if floor is None else internal_score >= floor), grade)
        for grade, days, floor in ladder
    ]
    return F.coalesce(*met, F.lit("E"))


def is_flagged(flag: Column) -> Column:
    """Read a suspicious flag that may be a boolean or one of several texts; null reads as not set."""
    return F.coalesce(F.lower(flag.cast("string")).isin(*TRUE_TOKENS), F.lit(False))


def label_for(code: Column, labels: dict[str, str]) -> Column:
    """Display label of a code, or the code itself when it has none."""
    pairs = F.create_map(*[F.lit(text) for text in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(pairs, code), code)
