"""Vector search, retrieval and corpus preparation expressed as Spark plans."""
