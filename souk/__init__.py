"""souk: a retail analytics engine expressed in Spark DataFrame and SQL operations."""
