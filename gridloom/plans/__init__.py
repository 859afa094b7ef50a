"""Process graphs compiled to Spark columns."""
