"""Loading the ledger from files.

``load_ledger`` reads the five tables from header CSV (every column a string,
then cleaned with ``try_*`` casts) or from Parquet (already typed).  File
names follow the raw data set: ``users_cards.csv``, ``cards_data.csv``,
``transaction_data.csv``, ``mcc_codes.csv`` and ``train_fraud_labels.csv``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import cleaning
from spendlens.plans.joins import may_match
from spendlens.sources import store
from spendlens.sources.schema import SCHEMAS, Ledger, conform, validate

# Raw file stems of the five tables.
FILE_STEMS = {
    "users": "users_cards",
    "cards": "cards_data",
    "transactions": "transaction_data",
    "mcc_codes": "mcc_codes",
    "fraud_labels": "train_fraud_labels",
}

_CLEANERS = {
    "users": cleaning.clean_users,
    "cards": cleaning.clean_cards,
    "transactions": cleaning.clean_transactions,
    "mcc_codes": cleaning.clean_mcc,
    "fraud_labels": cleaning.clean_labels,
}


#: A raw line that does not have the header's columns is kept whole in here.
CORRUPT = "_corrupt_record"
# Raw columns whose text must parse for a row to be of use.
MUST_PARSE = {
    "users": ["id"],
    "cards": ["id", "client_id"],
    "transactions": ["id", "client_id", "amount", "date"],
    "mcc_codes": ["mcc"],
    "fraud_labels": ["transaction_id", "is_fraud"],
}


def _read_csv(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    # Every column of the header as a string: cleaning does the typing.  Lines
    # of another width are kept, whole, in CORRUPT; ``whole`` lines are parsed
    # even where few columns are asked for, else their width goes unnoticed.
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*names, CORRUPT])
    return (spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnPruning", not whole)
            .option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))


def _problems(raw: DataFrame, clean: DataFrame, name: str) -> Column:
    """Reasons why a row cannot be used, in order: ``columns`` (a line of
    another width) or the columns whose text is missing or does not parse."""
    fails = [F.when(F.col(f"clean.{c}").isNull(), F.lit(c)) for c in MUST_PARSE[name] if c in raw.columns]
    return F.when(F.col(f"raw.{CORRUPT}").isNotNull(), F.array(F.lit("columns"))).otherwise(
        F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>"))


def _checked_csv(spark: SparkSession, data_path: str, name: str) -> DataFrame:
    """``(raw, clean, problems)`` of every data line of a CSV table."""
    raw = _read_csv(spark, os.path.join(data_path, f"{FILE_STEMS[name]}.csv"), whole=True)
    validate(raw, name)
    columns = [F.col(f"`{c}`") for c in raw.columns]
    both = raw.select(F.struct(*columns).alias("raw"), *columns)
    clean = _CLEANERS[name](both)
    typed = clean.select("raw", F.struct(*[F.col(f"`{c}`") for c in clean.columns if c not in ("raw", CORRUPT)]).alias("clean"))
    return typed.select("raw", "clean", _problems(raw, clean, name).alias("problems"))


def quarantine(spark: SparkSession, data_path: str, name: str) -> DataFrame:
    """The lines of a CSV table that ``load_table(..., strict=True)`` leaves
    out: ``reason`` (comma-joined) and the raw ``record`` (the line itself, or
    its fields as JSON)."""
    rows = _checked_csv(spark, data_path, name).where(F.size("problems") > 0)
    fields = F.to_json(F.col("raw").dropFields(CORRUPT))
    return rows.select(F.array_join("problems", ",").alias("reason"),
                       F.coalesce(F.col(f"raw.{CORRUPT}"), fields).alias("record"))


def load_table(spark: SparkSession, data_path: str, name: str, fmt: str = "csv", strict: bool = False) -> DataFrame:
    """One table, typed; columns that its schema does not list follow as they
    are.  Dirty fields of a CSV become nulls, as in the dashboard; ``strict``
    leaves out the rows that ``quarantine`` lists."""
    stem = FILE_STEMS[name]
    if fmt == "csv" and strict:
        rows = _checked_csv(spark, data_path, name).where(F.size("problems") == 0)
        df = rows.select("clean.*")
    elif fmt == "csv":
        raw = _read_csv(spark, os.path.join(data_path, f"{stem}.csv")).drop(CORRUPT)
        validate(raw, name)
        df = _CLEANERS[name](raw)
    elif fmt == "parquet":
        df = spark.read.parquet(os.path.join(data_path, f"{stem}.parquet"))
        if name == "transactions" and "year" not in df.columns:
            df = cleaning.with_calendar(df)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    validate(df, name)
    return conform(df, SCHEMAS[name], extra=True)


def load_ledger(spark: SparkSession, data_path: str | None, fmt: str = "csv") -> Ledger:
    """S1 + S5: all five tables, typed; ``fmt`` is ``csv``, ``parquet`` or
    ``stored`` (a folder of ``store.save_ledger``, which keeps the clients'
    activity, months and buckets)."""
    if not data_path:
        raise ValueError("Data path not set.")
    if fmt == "stored":
        return store.load_stored(spark, data_path)
    return Ledger(**{n: load_table(spark, data_path, n, fmt) for n in FILE_STEMS})


def user_list(ledger: Ledger, limit: int | None = None) -> DataFrame:
    """``(id, label)`` with ``User {id} - {address}`` of every user in order
    of id; a caller that fills a dropdown may pass a ``limit``."""
    users = (ledger.users.select(
                "id", F.concat(F.lit("User "), F.col("id").cast("string"), F.lit(" - "),
                               F.coalesce(F.col("address"), F.lit(""))).alias("label"))
            .orderBy("id"))
    return users if limit is None else users.limit(limit)


def client_slice(ledger: Ledger, client_id: int | None = None) -> Ledger:
    """S3 + F1 + J4 + S6: the tables restricted to one client (or, with
    ``None``, to the clients that exist); labels by semi join, never by a
    collected id list."""
    if client_id is None:
        tx = ledger.transactions
        users, cards = ledger.users, ledger.cards
    else:
        cid = F.lit(client_id).cast("long")
        users = ledger.users.filter(F.col("id") == cid)
        cards = ledger.cards.filter(F.col("client_id") == cid)
        tx = ledger.transactions.filter(F.col("client_id") == cid)
    labels = label_semi_join(ledger.fraud_labels, tx)
    return Ledger(users=users, cards=cards, transactions=tx,
                  mcc_codes=ledger.mcc_codes, fraud_labels=labels)


def current_portfolio(ledger: Ledger) -> DataFrame:
    """The cards that each client has now."""
    return ledger.cards.select("client_id", F.col("id").alias("card_id"), "card_brand", "card_type", "credit_limit")


def require_user(ledger: Ledger, client_id: int) -> None:
    """Raise when the user does not exist."""
    if ledger.users.filter(F.col("id") == F.lit(client_id).cast("long")).isEmpty():
        raise ValueError(f"User {client_id} not found")


def label_semi_join(labels: DataFrame, tx: DataFrame) -> DataFrame:
    """Labels whose transaction appears in ``tx`` (typed, possibly empty).
    Ids that cannot be a label's stay where they are (``may_match``); the others
    are de-duplicated first (map-side), so a transaction id repeated on many
    rows cannot make one build partition of the semi join hot."""
    ids = may_match(tx.select(F.col("id").alias("transaction_id")), labels, "transaction_id")
    return labels.join(ids.distinct(), "transaction_id", "left_semi")


def labelled_ids(ledger: Ledger) -> DataFrame:
    """J4 of a stored ledger: ``(transaction_id, labels, frauds)`` of the
    transactions that have a label, by a join of two tables bucketed alike: no
    exchange.  Any other ledger is joined by id."""
    if ledger.ids is not None and ledger.labels_by_id is not None:
        ids = ledger.ids.select(F.col("id").alias("transaction_id"))
        return ledger.labels_by_id.join(ids, "transaction_id", "left_semi")
    hit = label_semi_join(ledger.fraud_labels, ledger.transactions)
    return hit.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if("is_fraud").alias("frauds"))


def activity_counts(ledger: Ledger) -> DataFrame:
    """Per client, the number of transactions and cards loaded."""
    t = ledger.transactions.groupBy("client_id").agg(F.count(F.lit(1)).alias("transactions"))
    c = ledger.cards.groupBy("client_id").agg(F.count(F.lit(1)).alias("cards"))
    u = ledger.users.select(F.col("id").alias("client_id"))
    return (u.join(t, "client_id", "left").join(c, "client_id", "left")
            .select("client_id",
                    F.coalesce("transactions", F.lit(0).cast("long")).alias("transactions"),
                    F.coalesce("cards", F.lit(0).cast("long")).alias("cards")))


def render_raw_transactions(tx: DataFrame) -> DataFrame:
    """Render typed transactions back into the raw CSV text forms
    (``$-77.00``, ``yyyy-MM-dd HH:mm:ss``, ``M/yyyy``); amounts carry cents."""
    amt = F.col("amount")
    return tx.select(
        F.col("id").cast("string").alias("id"),
        F.col("client_id").cast("string").alias("client_id"),
        F.col("merchant_id").cast("string").alias("merchant_id"),
        F.col("mcc").cast("string").alias("mcc"),
        F.concat(F.lit("$"), F.format_number(amt, 2)).alias("amount"),
        F.date_format("date", cleaning.TIMESTAMP_FORMAT).alias("date"),
        F.date_format("date", "M/yyyy").alias("month_year"),
    )


def parse_raw_transactions(raw: DataFrame) -> DataFrame:
    """C1–C5 over the rendered strings."""
    df = raw.select(
        cleaning.parse_int("id", long=True).alias("id"),
        cleaning.parse_int("client_id", long=True).alias("client_id"),
        cleaning.parse_int("merchant_id", long=True).alias("merchant_id"),
        cleaning.parse_int("mcc").alias("mcc"),
        cleaning.parse_currency("amount").alias("amount"),
        cleaning.parse_timestamp("date").alias("date"),
        cleaning.parse_month_year("month_year").alias("month_start"),
    )
    return cleaning.with_calendar(df)
