"""Document retrieval and text analytics as Spark DataFrame, SQL and streaming plans."""
