"""Relational operators of the engine; every one takes and returns DataFrames."""
