from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from spendlens.sources.bindings import _mcc_codes  # noqa: E402
from spendlens.sources.schema import (CARDS, FRAUD_LABELS, MCC_CODES, TRANSACTIONS,  # noqa: E402
                                      USERS, Ledger, conform)


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="spendlens-tests",
                      extra={"spendlens.materializeLedger": "true"})
    yield s
    s.stop()


T0 = dt.datetime(2024, 6, 30, 12, 0, 0)


def ts(days: float = 0, seconds: float = 0, base: dt.datetime = T0) -> dt.datetime:
    return base - dt.timedelta(days=days, seconds=seconds)


def make_ledger(spark, tx, cards=None, users=None, mcc=None, labels=None) -> Ledger:
    """Ledger from literal rows.

    ``tx``: tuples ``(id, client_id, amount, date[, mcc[, merchant_id]])``;
    ``cards``: ``(id, client_id, brand, type, credit_limit)``;
    ``users``: ``(id, total_debt, credit_score)``; ``mcc``: ``(mcc, category)``
    (default: the bound test dimension); ``labels``: ``(transaction_id, is_fraud)``.
    """
    rows = []
    for t in tx:
        t = tuple(t) + (None,) * (6 - len(t))
        i, c, a, d, m, mer = t
        rows.append((i, c, None, mer if mer is not None else 1, m if m is not None else 1,
                     None, float(a), d, d.year, d.month, d.day))
    txdf = spark.createDataFrame(rows, TRANSACTIONS)
    clients = sorted({r[1] for r in rows})
    users = users if users is not None else [(c, 0.0, 700) for c in clients]
    udf = conform(spark.createDataFrame(
        [(u[0], u[1], u[2]) for u in users], "id long, total_debt double, credit_score int"),
        USERS)
    cdf = conform(spark.createDataFrame(
        cards or [], "id long, client_id long, card_brand string, card_type string, "
        "credit_limit double"), CARDS)
    mdf = (spark.createDataFrame(mcc, MCC_CODES) if mcc is not None
           else conform(_mcc_codes(spark), MCC_CODES))
    ldf = spark.createDataFrame(labels or [], FRAUD_LABELS)
    return Ledger(users=udf, cards=cdf, transactions=txdf, mcc_codes=mdf, fraud_labels=ldf)


def rows_by(df, key, *cols):
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in key) if isinstance(key, (list, tuple)) else r[key]
        out[k] = r if not cols else tuple(r[c] for c in cols)
    return out
