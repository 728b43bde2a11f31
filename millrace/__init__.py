"""Record pipelines on Spark."""
