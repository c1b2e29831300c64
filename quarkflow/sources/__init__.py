"""sources of the quarkflow engine."""
