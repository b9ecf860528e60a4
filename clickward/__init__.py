"""clickward: trustworthy click ingestion, features and model evaluation as Spark jobs."""
