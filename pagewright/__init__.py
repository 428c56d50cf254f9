"""Document analytics on Spark: ordered streams of typed page elements held in DataFrames."""
