"""The queries of the catalogue and the tables they read."""
