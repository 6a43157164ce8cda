"""Operators on assembly graphs held as vertex and edge DataFrames."""
