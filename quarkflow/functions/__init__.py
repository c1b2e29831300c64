"""functions of the quarkflow engine."""
