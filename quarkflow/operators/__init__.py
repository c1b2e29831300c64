"""operators of the quarkflow engine."""
