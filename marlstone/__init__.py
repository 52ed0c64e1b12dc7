"""marlstone: typed analytics, retrieval, ingestion, telemetry and evaluation as Spark plans."""
