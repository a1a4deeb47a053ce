"""textloom: a Spark-first engine that turns documents into clean, queryable text."""
