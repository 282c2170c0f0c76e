"""Versioned datasets on Spark: snapshots, diffs, merges, pruning plans and catalogs as DataFrames."""
