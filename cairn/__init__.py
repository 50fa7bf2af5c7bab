"""Archive inventory and integrity analytics as Spark jobs."""
