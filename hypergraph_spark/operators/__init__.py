"""Graph, embedding and evaluation operators."""
