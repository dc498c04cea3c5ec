"""Table access, dataset store and scratch space."""
