"""Scalar functions, each from Column to Column."""
