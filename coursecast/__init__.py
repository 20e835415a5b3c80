"""Course-enrollment analytics on Spark DataFrames."""
