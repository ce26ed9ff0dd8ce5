"""Operators of a large-scale training-data pipeline (archives, cleaning, mixing, search).

Every operator takes and returns DataFrames and has its own module; ``queries.py`` holds the
thin registered queries and ``oracles.py`` the DuckDB statements of those SQL can express.
Nothing else in the library imports this subpackage.
"""
