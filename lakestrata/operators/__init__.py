"""Relational operators over snapshots, commits and statistics. Each takes and returns DataFrames and collects nothing."""
