"""Scalar and aggregate expression helpers (C7–C26 and numeric rules N1–N3).

Money is stored as DOUBLE (as in the source files) but summed exactly: each
amount becomes whole cents (a long) and the long sums are converted back, so
totals are exact and independent of partition order, and the aggregation
buffers stay primitive (no wide-decimal arithmetic per row).  For amounts
with at most two decimals this is the same value as summing
``CAST(amount AS DECIMAL(18,2))``; a sub-cent amount rounds to the nearest
cent.  Rounding of derived figures always goes through a decimal.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(6,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Amount as an exact two-decimal value."""
    return col(c).cast(MONEY)


def cents(c: str | Column) -> Column:
    """Amount in whole cents (LONG)."""
    return F.rint(col(c) * 100).cast("long")


def cents_to_double(c: str | Column) -> Column:
    """Summed cents back to money: the correctly rounded DOUBLE of the exact
    total (the same double as casting the exact decimal total)."""
    return col(c) / F.lit(100.0)


def cents_to_dec(c: str | Column, precision: int = 28) -> Column:
    """Summed cents back to an exact DECIMAL(precision, 2)."""
    unit = F.lit(Decimal("0.01")).cast("decimal(3,2)")
    return (col(c).cast(f"decimal({precision - 2},0)") * unit).cast(f"decimal({precision},2)")


def money_sum(c: str | Column) -> Column:
    """Exact sum of money (N1), as DOUBLE."""
    return cents_to_double(F.sum(cents(c)))


def money_sum_dec(c: str | Column) -> Column:
    """Exact sum of money (N1), as DECIMAL(28,2) for further exact arithmetic."""
    return cents_to_dec(F.sum(cents(c)))


def round_dec(c: str | Column, k: int) -> Column:
    """Round half-up to ``k`` places through a decimal (N2), as DOUBLE."""
    return F.round(col(c).cast("decimal(28,8)"), k).cast("double")


def safe_div(n: str | Column, d: str | Column, default: float = 0.0) -> Column:
    """``n / d`` when ``d > 0``, else ``default`` (C20). ANSI-safe."""
    d = col(d)
    return F.when(d > 0, col(n) / d).otherwise(F.lit(default))


def pct_change(cur: str | Column, prev: str | Column) -> Column:
    """``(cur - prev) / prev * 100`` when ``prev > 0`` else 0."""
    prev = col(prev)
    return F.when(prev > 0, (col(cur) - prev) / prev * 100).otherwise(F.lit(0.0))


def clamp_max(c: str | Column, hi: float) -> Column:
    """Cap at ``hi``."""
    return F.least(col(c), F.lit(hi))


def clamp_min(c: str | Column, lo: float) -> Column:
    """Floor at ``lo``."""
    return F.greatest(col(c), F.lit(lo))


def truncate_label(c: str | Column, n: int) -> Column:
    """C17: first ``n`` characters plus ``...`` when longer than ``n``."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def money_text(c: str | Column) -> Column:
    """``$1,234.50`` (value rounded to cents first)."""
    return F.concat(F.lit("$"), F.format_number(round_dec(c, 2), 2))


def pct_text(c: str | Column, signed: bool = False) -> Column:
    """``3.0%`` or ``+3.0%`` (value rounded to one place first)."""
    r = round_dec(c, 1)
    txt = F.format_string("%.1f%%", r)
    if signed:
        txt = F.when(r >= 0, F.concat(F.lit("+"), txt)).otherwise(txt)
    return txt


def card_label(brand: str | Column, ctype: str | Column) -> Column:
    """``{brand} ({type})``."""
    return F.concat(col(brand), F.lit(" ("), col(ctype), F.lit(")"))


# ---- bands (C21–C25) ---------------------------------------------------

# Utilisation labels (below 30 %), credit-score labels (750, 650),
# and the fraud gauge's colour steps (25, 50, 75).
UTILIZATION_LABELS = ("Good", "High")
CREDIT_LABELS = ("Excellent", "Good", "Fair")
GAUGE_COLOURS = ("lightgreen", "yellow", "orange", "red")


def utilization_band(c: str | Column) -> Column:
    return F.when(col(c) < 30, UTILIZATION_LABELS[0]).otherwise(UTILIZATION_LABELS[1])


def credit_band(c: str | Column) -> Column:
    c = col(c)
    return (F.when(c >= 750, CREDIT_LABELS[0]).when(c >= 650, CREDIT_LABELS[1])
            .otherwise(CREDIT_LABELS[2]))


def fraud_band(c: str | Column) -> Column:
    c = col(c)
    return F.when(c < 5, "low").when(c < 15, "moderate").otherwise("high")


def gauge_step(c: str | Column) -> Column:
    """Gauge colour step of the fraud dial: 0–25, 25–50, 50–75, 75–100."""
    c = col(c)
    return (F.when(c < 25, GAUGE_COLOURS[0]).when(c < 50, GAUGE_COLOURS[1])
            .when(c < 75, GAUGE_COLOURS[2]).otherwise(GAUGE_COLOURS[3]))


def improvement_band(c: str | Column) -> Column:
    c = col(c)
    return (F.when(c > 100, "excellent").when(c > 50, "good")
            .when(c > 0, "minor").otherwise("optimized"))


def payback_band(years: str | Column) -> Column:
    y = col(years)
    return (F.when(y <= 0, "immediate").when(y < 1, "under_one_year")
            .when(y < 2, "reasonable").otherwise("long"))


def payback_months_band(years: str | Column) -> Column:
    """C25, months form: bands of the truncated months (6, 12); no fees to
    recover pays back at once."""
    m = payback_months(years)
    return (F.when(col(years) <= 0, "immediate").when(m <= 6, "quick")
            .when(m <= 12, "reasonable").otherwise("long"))


def payback_months(years: str | Column) -> Column:
    """Whole months, truncated."""
    return (col(years) * 12).cast("int").cast("long")
