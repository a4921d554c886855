"""Media-job analytics on PySpark: resolve, deduplicate, replay and query conversion jobs."""
