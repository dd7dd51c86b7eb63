"""Content-risk analytics and corpus preparation on PySpark DataFrames."""
