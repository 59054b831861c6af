"""Code-repair benchmark analytics as Spark DataFrame jobs."""
