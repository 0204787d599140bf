"""Index directories and the choice between exact and graph search."""
