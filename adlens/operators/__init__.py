"""Analytic operators: lazy ``DataFrame -> DataFrame`` functions."""
