"""Operators over DataFrames: search, batches, masks, windows, ranking."""
