"""plans of the quarkflow engine."""
