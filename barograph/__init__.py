"""Market time-series analytics on Spark: one long table of bars for all assets, DataFrame in and out."""
