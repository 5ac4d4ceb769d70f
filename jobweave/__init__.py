"""Job-posting matching and trend analytics as Spark DataFrame jobs."""
