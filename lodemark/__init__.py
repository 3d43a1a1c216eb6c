"""Market-intelligence analytics as Spark jobs."""
