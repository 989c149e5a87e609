"""Sparse matrix analytics on Spark: coordinate tables, packed rows, products and run statistics as DataFrames."""
