"""Evidence-backed claim graphs on Spark: ingestion, resolution, validation, review and projection."""
