"""Graph and hypergraph algorithms: each returns a DataFrame."""
