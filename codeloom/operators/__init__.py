"""Operators over DataFrames: graph, search, knowledge tables, incremental refresh."""
