"""Independent SQL forms of the queries, for comparing results."""
