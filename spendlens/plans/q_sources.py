"""Registered source and sink queries over files that Spark writes from the
given tables first: a dirty CSV (S1), the stored ledger (F8, J3, J4) and the
exports read back (S8–S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import cleaning
from spendlens.operators import kpis, spending
from spendlens.operators.rewards import Rewards
from spendlens.plans.q_rewards import category_extra_rewards as extra_rewards
from spendlens.plans.q_spending import breakdown_sql
from spendlens.plans.registry import QUERIES, exchanges_for, register, scratch
from spendlens.plans.sqlkit import MS, R, anchor_cte, q, with_ledger
from spendlens.sources import loaders, sinks, store

# ---- a real CSV with dirty values (S1) ----------------------------------------

#: Every line whose id leaves this remainder modulo 97 is made dirty so.
_DIRT = {1: "amount", 2: "date", 3: "client_id", 4: "columns"}


def _csv_folder(led) -> str:
    """The raw CSV of the ledger's transactions, written once a session: amounts
    as ``$1,234.50`` or ``$-5.00``, months as ``9/2022``, columns that no schema
    lists, junk fields and lines of another width."""
    def build() -> str:
        t = loaders.render_raw_transactions(led.transactions).withColumn("n", F.col("id").cast("long"))
        at = F.col("n") % 97
        fields = {
            "id": F.col("id"), "date": F.when(at == 2, "not a date").otherwise(F.col("date")),
            "client_id": F.when(at == 3, "?").otherwise(F.col("client_id")),
            "amount": F.concat(F.lit('"'), F.when(at == 1, "n/a").otherwise(F.col("amount")), F.lit('"')),
            "use_chip": F.when(F.col("n") % 2 == 0, "Chip").otherwise("Swipe"),
            "merchant_id": F.col("merchant_id"), "mcc": F.col("mcc"), "expires": F.col("month_year"),
            "errors": F.when(at == 4, "Bad PIN,too,many,fields").otherwise("")}
        line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in fields.values()])
        path = scratch(led.spark, "csv")
        # One header a file, as any exporter of several files writes it.  Files come
        # as the rows lie: their number grows with the input, and no row moves again.
        lines = t.select(line.alias("line"))
        with exchanges_for(led.transactions):
            lines.mapInArrow(_with_header(",".join(fields)), "line string").write.text(f"{path}/transaction_data.csv")
        return path
    return led.memo(("csv",), build)


def _with_header(head: str):
    def run(batches):
        import pyarrow as pa
        for i, b in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], schema=b.schema)
            yield b
    return run


@register("csv_transactions", "O", "S1, C1–C5", with_ledger("O") + (
    "SELECT id, client_id, merchant_id, mcc, amount, date, strftime(date_trunc('month', date), '%Y-%m-%d') AS month_start, "
    "year, month, day, CASE WHEN id % 2 = 0 THEN 'Chip' ELSE 'Swipe' END AS use_chip FROM tx "
    f"WHERE id % 97 NOT IN ({', '.join(map(str, _DIRT))})"), ts=("date",))
def csv_transactions(led):
    df = loaders.load_table(led.spark, _csv_folder(led), "transactions", "csv", strict=True)
    return df.select("id", "client_id", "merchant_id", "mcc", "amount", "date",
                     F.date_format(cleaning.parse_month_year("expires"), "yyyy-MM-dd").alias("month_start"),
                     "year", "month", "day", "use_chip")


@register("csv_quarantine", "O", "S1, C4", with_ledger("O") + (
    "SELECT CASE id % 97 " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in _DIRT.items())
    + f" END AS reason, COUNT(*) AS lines FROM tx WHERE id % 97 IN ({', '.join(map(str, _DIRT))}) GROUP BY 1"))
def csv_quarantine(led):
    bad = loaders.quarantine(led.spark, _csv_folder(led), "transactions")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


# ---- the stored ledger (F8, J3, J4) --------------------------------------------

#: The loads are cut at these dates, which belong to the second.
_CUTS = ("1996-06-01", "1999-01-01")


def _by_load(led) -> list[DataFrame]:
    """The transactions of the three loads.  They are written once, apart by
    load, so that no load makes the whole ledger's joins again."""
    date, (lo, hi) = F.col("date"), (F.lit(x).cast("timestamp_ntz") for x in _CUTS)
    part = F.when(date < lo, 1).when(date.between(lo, hi), 2).when(date > hi, 3)
    path = scratch(led.spark, "loads")
    tx = led.transactions
    tx.withColumn("part", part).where("part is not null").write.partitionBy("part").parquet(path)
    rows = led.spark.read.schema(T.StructType([*tx.schema, T.StructField("part", T.IntegerType())])).parquet(path)
    return [rows.where(F.col("part") == n).drop("part") for n in (1, 2, 3)]


def _stored(led):
    """The ledger kept as three loads by date, and loaded again."""
    def build():
        path = scratch(led.spark, "store")
        with exchanges_for(led.transactions):
            parts = _by_load(led)
            store.save_ledger(type(led)(**{**led.tables(), "transactions": parts[0]}), path)
            for more in parts[1:]:
                store.append_transactions(led.spark, path, more)
        return loaders.load_ledger(led.spark, path, fmt="stored")
    return led.memo(("stored",), build)


@register("stored_category_breakdown", "N", "S1, F3, F8, B2", with_ledger("N", *breakdown_sql(90)) + "SELECT * FROM b")
def stored_category_breakdown(led):
    return spending.category_breakdown(_stored(led), "3_months")


@register("stored_monthly_spending", "O", "F5, F8, A1", with_ledger("O", anchor_cte()) + (
    "SELECT u.id AS client_id, COALESCE(s.d, 0.0) AS monthly_spending FROM users u LEFT JOIN ("
    f"SELECT t.client_id, {MS('t.amount')} AS d FROM tx t JOIN anch a ON a.client_id = t.client_id WHERE t.amount > 0 "
    "AND t.date >= a.anchor - INTERVAL 30 DAY GROUP BY t.client_id) s ON s.client_id = u.id"))
def stored_monthly_spending(led):
    return kpis.monthly_spending(_stored(led), 1)


@register("stored_labels", "O", "J3, J4", with_ledger("O") + (
    "SELECT transaction_id, COUNT(*) AS labels, COUNT(*) FILTER (WHERE is_fraud) AS frauds FROM fraud "
    "WHERE transaction_id IN (SELECT id FROM tx) GROUP BY transaction_id"))
def stored_labels(led):
    return loaders.labelled_ids(_stored(led))


# ---- exports, read back (S8–S12) -------------------------------------------------

def _read_back(df: DataFrame) -> DataFrame:
    """Write a result as header CSV, read it, and give the columns their types;
    a CSV does not tell null from empty text, so both are empty."""
    path = scratch(df.sparkSession, "export")
    sinks.write_csv(df, path)
    back = sinks.read_csv(df.sparkSession, path)
    typed = [F.coalesce(f.name, F.lit("")) if f.dataType.typeName() == "string" else F.col(f.name).cast(f.dataType)
             for f in df.schema]
    return back.select(*[c.alias(n) for c, n in zip(typed, df.columns, strict=True)])


@register("export_breakdown", "N", "S8", QUERIES["category_breakdown"].sql)
def export_breakdown(led):
    return _read_back(spending.category_breakdown(led, "3_months"))


@register("export_top_merchants", "N", "S9", QUERIES["top_merchants"].sql, ts=QUERIES["top_merchants"].ts)
def export_top_merchants(led):
    return _read_back(spending.top_merchants(led, "3_months", 10))


_ALL = f"(SELECT * FROM ({QUERIES['spending_patterns'].sql}) p WHERE dimension = 'all')"


@register("export_patterns", "E", "S10", " UNION ALL ".join(
    f"SELECT client_id, {q(m)} AS \"Metric\", {v} AS \"Value\" FROM {_ALL} a" for m, v in zip(
        sinks.PATTERN_METRICS,
        ["CAST(transactions AS VARCHAR)", *(f"printf('$%.2f', {R(c, 2)})" for c in (
            "avg_transaction", "max_transaction", "min_transaction"))], strict=True)))
def export_patterns(led):
    return _read_back(sinks.patterns_summary(spending.spending_patterns(led, "3_months")))


@register("export_rewards", "N", "S11", QUERIES["category_extra_rewards"].sql)
def export_rewards(led):
    return _read_back(extra_rewards(led))


@register("export_action_plan", "N", "S12", (
    "SELECT client_id, action_priority AS \"Priority\", printf(" + q(sinks.ACTION_TEXT) + ", best_card, category) AS \"Action\", "
    + q(sinks.CURRENT_RATE_TEXT) + " AS \"Current_Rate\", printf('%.1f%%', " + R("best_reward_rate", 1) + ") AS \"New_Rate\", "
    "printf('$%.2f', " + R("additional_rewards", 2) + ") AS \"Annual_Gain\" FROM ("
    + QUERIES["category_extra_rewards"].sql + ") e WHERE action_priority > 0"))
def export_action_plan(led):
    return _read_back(sinks.action_plan(Rewards.of(led, "1_year").category_extra_rewards()))
