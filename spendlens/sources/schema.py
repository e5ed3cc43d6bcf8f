"""Typed schemas of the five ledger tables and the ``Ledger`` container."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("current_age", T.IntegerType()),
    T.StructField("retirement_age", T.IntegerType()),
    T.StructField("birth_year", T.IntegerType()),
    T.StructField("birth_month", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("per_capita_income", T.DoubleType()),
    T.StructField("yearly_income", T.DoubleType()),
    T.StructField("total_debt", T.DoubleType()),
    T.StructField("credit_score", T.IntegerType()),
    T.StructField("num_credit_cards", T.IntegerType()),
])

CARDS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("card_brand", T.StringType()),
    T.StructField("card_type", T.StringType()),
    T.StructField("expires", T.DateType()),
    T.StructField("cvv", T.IntegerType()),
    T.StructField("num_cards_issued", T.IntegerType()),
    T.StructField("credit_limit", T.DoubleType()),
    T.StructField("acct_open_date", T.DateType()),
    T.StructField("year_pin_last_changed", T.IntegerType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("card_id", T.LongType()),
    T.StructField("merchant_id", T.LongType()),
    T.StructField("mcc", T.IntegerType()),
    T.StructField("zip", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

MCC_CODES = T.StructType([
    T.StructField("mcc", T.IntegerType()),
    T.StructField("category", T.StringType()),
])

FRAUD_LABELS = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("is_fraud", T.BooleanType()),
])

SCHEMAS = {
    "users": USERS,
    "cards": CARDS,
    "transactions": TRANSACTIONS,
    "mcc_codes": MCC_CODES,
    "fraud_labels": FRAUD_LABELS,
}

# Columns without which a table gives wrong answers.
REQUIRED = {
    "users": ["id"],
    "cards": ["id", "client_id"],
    "transactions": ["id", "client_id", "merchant_id", "mcc", "amount", "date"],
    "mcc_codes": ["mcc", "category"],
    "fraud_labels": ["transaction_id", "is_fraud"],
}


#: Month of a transaction (``yyyymm``) in a stored ledger, which is partitioned by it.
MONTH_COL = "tx_month"


def conform(df: DataFrame, schema: T.StructType, extra: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, same order, same types.
    With ``extra`` columns that the schema does not list follow as they are.

    Missing columns become typed nulls; columns must otherwise already hold
    values of a compatible type (cleaning happens before this step).
    """
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name)
            if df.schema[f.name].dataType != f.dataType:
                c = c.cast(f.dataType)
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    if extra:
        cols += [F.col(f"`{c}`") for c in df.columns if c not in schema.names]
    return df.select(*cols)


def validate(df: DataFrame, name: str) -> None:
    """Raise ``ValueError`` when a table as read lacks a required column (S5);
    to be called before ``conform`` fills missing columns with nulls."""
    missing = [c for c in REQUIRED[name] if c not in df.columns]
    if missing:
        raise ValueError(f"table {name!r} lacks columns {missing}")


@dataclass
class Ledger:
    """The five cleaned tables the analytics run on.

    ``mcc_codes`` may be ``None``: categories then come from the built-in
    fallback map.  ``activity`` has one row per client (latest date, latest
    purchase date, number of transactions); a stored ledger keeps it, so that
    period operators read the transactions once.  ``ids`` and ``labels_by_id``
    are the transaction ids and the labels of a stored ledger, bucketed alike.
    """

    users: DataFrame
    cards: DataFrame
    transactions: DataFrame
    mcc_codes: DataFrame | None
    fraud_labels: DataFrame
    activity: DataFrame | None = field(default=None, repr=False)
    ids: DataFrame | None = field(default=None, repr=False)
    labels_by_id: DataFrame | None = field(default=None, repr=False)
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.transactions.sparkSession

    def client_activity(self) -> DataFrame:
        """``(client_id, last_date, last_purchase, n_transactions)``."""
        if self.activity is None:
            date = F.col("date")
            self.activity = self.transactions.groupBy("client_id").agg(
                F.max(date).alias("last_date"),
                F.max(F.when(F.col("amount") > 0, date)).alias("last_purchase"),
                F.count(F.lit(1)).alias("n_transactions"))
        return self.activity

    def memo(self, key: tuple, build):
        """Shared lazy intermediate (a DataFrame or an analysis object) of
        this ledger: operators built from the same pieces reuse one plan,
        so Spark can reuse its stages and the plan is analysed once."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def tables(self) -> dict[str, DataFrame]:
        return {
            "users": self.users,
            "cards": self.cards,
            "transactions": self.transactions,
            "mcc_codes": self.mcc_codes,
            "fraud_labels": self.fraud_labels,
        }
