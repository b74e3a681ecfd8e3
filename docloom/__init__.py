"""Document-analytics operators on PySpark DataFrames."""
