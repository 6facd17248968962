"""Structured Streaming jobs.  Polling intervals become triggers; the state of a
feed (stored alerts, snapshot table) lives in parquet, written per batch."""
