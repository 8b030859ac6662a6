"""Product-telemetry pipelines expressed as Spark DataFrame jobs."""
