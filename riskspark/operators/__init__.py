"""Table operators: each takes DataFrames and a configuration and returns a DataFrame."""
