"""Spatial, segmented-array and sparse-tensor analytics on Spark DataFrames.

Tables have no order of their own: every order-sensitive operator takes the order key as a parameter, and every
operator maps DataFrames to DataFrames or Columns to Columns.
"""
