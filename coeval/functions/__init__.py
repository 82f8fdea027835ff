"""Scalar column builders; every one stays inside generated code."""
