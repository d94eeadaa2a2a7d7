"""Supply-forecast and inventory-risk analytics as Spark jobs."""
