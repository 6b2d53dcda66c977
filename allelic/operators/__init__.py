"""Operators on variant tables: DataFrames in, DataFrames out."""
