"""Document-lifecycle analytics for Spark: DataFrame in, DataFrame out."""
