"""gridloom: space-time raster datacubes as Spark DataFrames."""
