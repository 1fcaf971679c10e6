"""A Spark-first engine for tabular questions, retrieval over documents and log analytics."""
