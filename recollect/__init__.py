"""recollect: personal and video memory analytics on PySpark DataFrames."""
