"""quirework: layout-document analytics on Spark DataFrames."""
