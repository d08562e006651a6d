"""Operators on DataFrames: lazy, without Python UDFs, safe for hot keys."""
