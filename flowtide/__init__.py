"""Network-flow intrusion analytics on Spark DataFrames."""
