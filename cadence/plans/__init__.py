"""The named metrics (one module per dashboard) and the ingest jobs."""
