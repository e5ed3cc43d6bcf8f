"""spendlens — card-spending analytics as lazy Spark DataFrame operators.

Every operator takes a :class:`~spendlens.sources.schema.Ledger` (five typed
DataFrames) and returns a DataFrame keyed by ``client_id``: the answer for all
clients at once.  A single client is just ``.filter(col("client_id") == x)``.
"""

from spendlens.sources.schema import Ledger

__all__ = ["Ledger"]
