"""trailmark: a Spark-first analytics engine for trajectory and instruction data."""
