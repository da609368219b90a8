"""docassay: document-verification and corpus analytics as Spark jobs."""
