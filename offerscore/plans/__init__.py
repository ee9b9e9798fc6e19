"""Query plans: the reference's two entry flows and the named query catalog."""
