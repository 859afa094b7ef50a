"""Processes of callbacks as Spark columns."""
