"""Assembly-graph analytics as Spark jobs."""
