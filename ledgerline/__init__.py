"""Ledgerline: an evidence ledger expressed as Spark DataFrame, SQL and Structured Streaming jobs."""
