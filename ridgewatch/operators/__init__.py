"""Relational and order-dependent operators."""
