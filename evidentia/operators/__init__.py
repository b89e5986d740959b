"""DataFrame operators over activity events and artifact tables."""
