"""Readers. Facts come back as DataFrames; only small dimensions are parsed on the driver."""
