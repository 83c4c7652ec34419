"""Structured Streaming forms of batch imports and event logs."""
