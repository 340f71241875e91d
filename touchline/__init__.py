"""Entity scoring and line-up analytics as Spark DataFrame jobs."""
