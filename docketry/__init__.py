"""Document-record analytics on Spark: DataFrame-to-DataFrame operators."""
