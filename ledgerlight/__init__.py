"""Business-analytics operators for Spark tables and streams."""
