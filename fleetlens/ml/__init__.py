"""Models trained and applied on the cluster."""
