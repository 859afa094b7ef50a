"""Cubes from streams."""
