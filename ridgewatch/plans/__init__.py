"""Logical plans: domain views and the query catalogue."""
