"""Training-data operators over the documents, pages and embeddings tables; nothing else in the package imports this."""
