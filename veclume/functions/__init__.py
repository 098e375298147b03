"""Column builders and Arrow functions for vectors, codes, metadata and embeddings."""
