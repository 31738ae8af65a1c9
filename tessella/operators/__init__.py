"""Operators on snapshots, chunks, transfers, stored objects and metrics; each takes and returns DataFrames."""
