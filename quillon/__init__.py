"""Vector and catalogue analytics as Spark DataFrame operations."""
