"""Commerce-catalog analytics expressed as Spark DataFrame jobs."""
