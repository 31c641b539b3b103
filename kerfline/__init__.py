"""Document analytics and corrective retrieval as Spark jobs."""
