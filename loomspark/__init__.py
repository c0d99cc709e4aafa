"""loomspark: retrieval, curation and corpus analytics as Spark DataFrame jobs."""
