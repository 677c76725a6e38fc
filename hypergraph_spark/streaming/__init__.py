"""Structured Streaming: graphs and embeddings kept up to date by micro-batches."""
