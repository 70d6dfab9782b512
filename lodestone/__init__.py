"""lodestone: retrieval over text and knowledge graphs as Spark DataFrame operators."""
