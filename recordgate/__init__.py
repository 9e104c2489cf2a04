"""recordgate: tabular ingest, validation, apply and reconcile as Spark jobs."""
