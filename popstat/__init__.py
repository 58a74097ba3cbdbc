"""Population-genomics statistics as Spark DataFrame jobs."""
