"""quarkflow of the quarkflow engine."""
