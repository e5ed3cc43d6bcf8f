"""Cleaning of raw string columns.

Raw CSV columns arrive as strings.  All parsing uses ``try_*`` forms so that
dirty values become NULL instead of failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.exprs import col

# Formats the raw files use.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIMESTAMP_LAYOUT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
MONTH_YEAR_SUFFIX = "/01"
MONTH_YEAR_FORMAT = "M/yyyy/dd"


def parse_currency(c: str | Column) -> Column:
    """``$1,234.50`` → 1234.5, ``$-12.50`` → -12.5, junk → NULL.
    (``translate`` deletes the ``$`` and ``,`` characters, without a regex.)"""
    return F.translate(col(c), "$,", "").try_cast("double")


def parse_month_year(c: str | Column) -> Column:
    """``9/2022`` or ``09/2022`` → 2022-09-01; invalid → NULL."""
    return F.try_to_date(F.concat(col(c), F.lit(MONTH_YEAR_SUFFIX)), MONTH_YEAR_FORMAT)


def parse_timestamp(c: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` → TIMESTAMP_NTZ; invalid → NULL.

    The layout is checked first and the text then cast straight to a
    zone-free timestamp, so the session time zone never shifts a wall-clock
    value (no daylight-saving gap), and impossible dates give NULL."""
    c = col(c)
    return F.when(c.rlike(TIMESTAMP_LAYOUT), c.try_cast("timestamp_ntz"))


def parse_int(c: str | Column, long: bool = False) -> Column:
    """C4: integer cast that yields NULL on junk (``'3.0'`` included)."""
    return col(c).try_cast("bigint" if long else "int")


def parse_double(c: str | Column) -> Column:
    return col(c).try_cast("double")


def parse_bool(c: str | Column) -> Column:
    """C4: ``Yes``/``No``/``true``/``false`` → BOOLEAN."""
    return col(c).try_cast("boolean")


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Derived year, month and day-of-month columns."""
    d = F.col(date_col)
    return (df.withColumn("year", F.year(d))
              .withColumn("month", F.month(d))
              .withColumn("day", F.dayofmonth(d)))


def day_name(c: str | Column) -> Column:
    """Full English day name (``Monday``)."""
    return F.date_format(col(c), "EEEE")


def month_key(c: str | Column) -> Column:
    """``yyyy-MM``."""
    return F.date_format(col(c), "yyyy-MM")


def month_label(c: str | Column) -> Column:
    """``March 2024``."""
    return F.date_format(col(c), "MMMM yyyy")


def clean_users(raw: DataFrame) -> DataFrame:
    ints = ["current_age", "retirement_age", "birth_year", "birth_month",
            "credit_score", "num_credit_cards"]
    df = raw
    for m in ["per_capita_income", "yearly_income", "total_debt"]:
        if m in df.columns:
            df = df.withColumn(m, parse_currency(m))
    df = df.withColumn("id", parse_int("id", long=True))
    for c in ints:
        if c in df.columns:
            df = df.withColumn(c, parse_int(c))
    for c in ["latitude", "longitude"]:
        if c in df.columns:
            df = df.withColumn(c, parse_double(c))
    return df


def clean_cards(raw: DataFrame) -> DataFrame:
    df = raw.withColumn("credit_limit", parse_currency("credit_limit"))
    df = df.withColumn("id", parse_int("id", long=True)).withColumn(
        "client_id", parse_int("client_id", long=True))
    for c in ["cvv", "num_cards_issued", "year_pin_last_changed"]:
        if c in df.columns:
            df = df.withColumn(c, parse_int(c))
    for c in ["expires", "acct_open_date"]:
        if c in df.columns:
            df = df.withColumn(c, parse_month_year(c))
    return df


def clean_transactions(raw: DataFrame) -> DataFrame:
    df = raw.withColumn("amount", parse_currency("amount"))
    for c in ["id", "client_id", "card_id", "merchant_id"]:
        if c in raw.columns:
            df = df.withColumn(c, parse_int(c, long=True))
    if "zip" in raw.columns:
        df = df.withColumn("zip", parse_double("zip"))
    df = df.withColumn("mcc", parse_int("mcc")).withColumn("date", parse_timestamp("date"))
    return with_calendar(df)


def clean_mcc(raw: DataFrame) -> DataFrame:
    return raw.withColumn("mcc", parse_int("mcc"))


def clean_labels(raw: DataFrame) -> DataFrame:
    return (raw.withColumn("transaction_id", parse_int("transaction_id", long=True))
               .withColumn("is_fraud", parse_bool("is_fraud")))
