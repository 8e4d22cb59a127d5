"""Document-archive analytics as Spark DataFrame operators."""
