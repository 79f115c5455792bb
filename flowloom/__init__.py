"""flowloom: traffic-flow analytics on Spark DataFrames."""
