"""Bounded, repeatable pull streams over DataFrames."""
