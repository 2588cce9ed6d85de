"""Table readers, page parsing, the feature store and the model registry."""
