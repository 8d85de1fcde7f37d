"""End-to-end flows (score, train, recommend) and the registered queries."""
