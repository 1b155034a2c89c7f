"""Structured Streaming variants: ledger refresh and scenario scoring (foreachBatch, availableNow)."""
