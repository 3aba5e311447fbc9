"""veilmark: barrier-detectability analytics on Spark DataFrames."""
