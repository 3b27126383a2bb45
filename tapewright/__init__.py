"""A market-data research engine on PySpark."""
