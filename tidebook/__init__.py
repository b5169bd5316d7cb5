"""tidebook: trading, customer and portfolio analytics as Spark DataFrame jobs."""
