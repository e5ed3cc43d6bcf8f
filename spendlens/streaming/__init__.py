"""Streaming entry points (incremental loading of the raw transaction feed)."""

from spendlens.streaming.ingest import start_ingest, transaction_stream

__all__ = ["start_ingest", "transaction_stream"]
