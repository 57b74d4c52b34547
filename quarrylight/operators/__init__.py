"""Operators on DataFrames that the queries are composed of."""
