"""arcweave: analysis of large directed link graphs with PySpark DataFrames."""
