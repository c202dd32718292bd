"""Identity-gallery and embedding analytics on PySpark DataFrames."""
