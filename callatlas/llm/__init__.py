"""Training-data operators over documents, pages and embeddings; nothing outside this subpackage imports it."""
