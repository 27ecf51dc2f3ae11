"""zealmark: interest scoring for event and social platforms, written as Spark DataFrame jobs."""
