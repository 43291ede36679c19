"""Survey statistics on Spark: ingest, profile, clean, summarise, estimate, report."""
