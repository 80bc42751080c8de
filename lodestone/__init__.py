"""lodestone: a Spark-first specification, retrieval and training-data analytics engine."""
