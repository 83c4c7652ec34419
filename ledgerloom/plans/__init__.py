"""Composite plans and the queries that apply operators to the driver's tables."""
