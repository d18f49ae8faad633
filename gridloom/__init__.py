"""gridloom: raster and coloured-grid analytics on Spark DataFrames."""
