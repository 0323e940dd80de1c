"""Device-log analytics on Spark: ingest, clean, store, summarise and score device logs."""
