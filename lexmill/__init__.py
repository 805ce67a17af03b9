"""lexmill: document analytics on PySpark DataFrames."""
