"""Operators: metrics, alignment, geometry, aggregation and reshaping over DataFrames."""
