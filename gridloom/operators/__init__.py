"""Cube operators: each takes and returns cubes (or plain DataFrames) and stays lazy."""
