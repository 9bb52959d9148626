"""Operators: each module takes and returns DataFrames and leaves the physical plan to Catalyst."""
