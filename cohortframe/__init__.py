"""Cohort analytics over single-cell tables, written as plain PySpark DataFrame code.

Cells, expression values, signatures, gates and embeddings are long tables with explicit
keys.  Every operator is a function from DataFrame to DataFrame.
"""
