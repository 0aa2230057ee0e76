"""Environmental time series and gridded data on Spark DataFrames."""
