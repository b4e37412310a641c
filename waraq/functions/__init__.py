"""Scalar and text functions as Column expressions."""
