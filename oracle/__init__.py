"""Independent SQL for checking the Spark queries with another engine."""
