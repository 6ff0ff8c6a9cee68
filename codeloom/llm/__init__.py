"""Operators for large-scale training-data pipelines, one module each.

Nothing else in the library imports this subpackage.  Every module offers a
general operator (DataFrames in, DataFrames or files out) and a thin
``opN_<name>(spark, sf_dir)`` query over the standard tables.
"""
