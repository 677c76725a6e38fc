"""Column specs and the hypergraph plan."""
