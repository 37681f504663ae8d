"""cairn: knowledge-graph and corpus analytics as Spark DataFrame jobs."""
