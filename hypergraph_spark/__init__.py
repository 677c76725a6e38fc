"""A PySpark-native engine for entity hypergraphs: rows become hyperedges, hyperedges a Markov graph, graphs embeddings."""
