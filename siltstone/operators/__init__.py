"""Operators over DataFrames: index, ranking, filters, aggregations, ordering."""
