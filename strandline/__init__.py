"""strandline: record linkage, web-corpus and labelling operators as lazy Spark DataFrames."""
