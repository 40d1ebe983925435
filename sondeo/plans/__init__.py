"""End-to-end analyses composed from the operators, and the query catalog."""
