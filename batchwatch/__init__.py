"""Data-drift, data-quality and model-health monitoring as Spark jobs."""
