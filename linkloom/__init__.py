"""Link prediction and graph analytics on Spark DataFrames."""
