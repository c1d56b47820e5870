"""flowlake: NAT connection-log analytics on Spark DataFrames."""
