"""factweave: financial filing evidence analytics as Spark jobs."""
